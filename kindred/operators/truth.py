"""Labelled truth: nested and flat form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.cleaning import first_filled, join_list, split_list

_TEXT = T.StringType()

#: one labelled pair; the name key has two spellings and the industry is a list
PAIR = T.StructType(
    [
        T.StructField("company-name", _TEXT),
        T.StructField("company_name", _TEXT),
        T.StructField("industry", _TEXT),
        T.StructField("country", _TEXT),
        T.StructField("source", _TEXT),
    ]
)
RECORD = T.StructType([T.StructField("pairs", T.ArrayType(PAIR)), T.StructField("match", T.BooleanType())])
DOCUMENT = T.StructType([T.StructField("ground_truth", T.ArrayType(RECORD))])


def flatten_truth(documents: DataFrame, col: str = "document") -> DataFrame:
    """JSON documents → one row per labelled pair.

    Lists are joined with ``"; "``, missing texts are empty, a missing name is ``UNKNOWN``.
    """
    records = documents.select(F.explode_outer(F.from_json(col, DOCUMENT)["ground_truth"]).alias("r"))
    records = records.filter(F.col("r").isNotNull())
    sides = {"a": 0, "b": 1}
    cols: list[Column] = []
    for side, at in sides.items():
        pair = F.get(F.col("r.pairs"), F.lit(at))
        # a list of industries arrives as its JSON text
        industry = pair["industry"]
        many = F.from_json(industry, T.ArrayType(_TEXT))
        listed = F.when(industry.startswith("["), join_list(many)).otherwise(industry)
        cols += [
            first_filled(pair["company-name"], pair["company_name"]).alias(f"company_{side}"),
            F.coalesce(listed, F.lit("")).alias(f"industry_{side}"),
            F.coalesce(pair["country"], F.lit("")).alias(f"country_{side}"),
            F.coalesce(pair["source"], F.lit("")).alias(f"source_{side}"),
        ]
    return records.select(*cols, F.coalesce(F.col("r.match").cast("int"), F.lit(0)).alias("label"))


def unnamed(flat: DataFrame) -> DataFrame:
    """Labelled pairs that lack a name on a side."""
    return flat.filter((F.col("company_a") == "UNKNOWN") | (F.col("company_b") == "UNKNOWN"))


def side_struct(name: Column, industry: Column, country: Column, source: Column) -> Column:
    return F.struct(
        name.alias("company-name"), industry.alias("industry"), country.alias("country"), source.alias("source")
    )


def nested_truth(flat: DataFrame) -> DataFrame:
    """Flat labelled pairs → ``pairs`` (two structs, industries as lists) and ``match``."""

    def side(s: str) -> Column:
        return side_struct(
            F.col(f"company_{s}"), split_list(f"industry_{s}"), F.col(f"country_{s}"), F.col(f"source_{s}")
        )

    return flat.select(F.array(side("a"), side("b")).alias("pairs"), (F.col("label") == 1).alias("match"))


def write_truth(nested: DataFrame, path: str) -> None:
    """Nested labelled pairs as JSON documents, one per line, as :func:`read_truth` reads them."""
    record = F.struct("pairs", "match")
    document = F.to_json(F.struct(F.array(record).alias("ground_truth")), {"ignoreNullFields": "false"})
    nested.select(document.alias("value")).write.mode("overwrite").text(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Flat labelled pairs of a folder of JSON documents."""
    return flatten_truth(spark.read.text(path), "value")
