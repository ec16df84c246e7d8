"""Schema mapping: a declarative spec compiled to column expressions, one select per source."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.cleaning import collapse_spaces, list_literal, literal_pattern, strip

SOURCE_COLUMN = "_source_table"


@dataclass(frozen=True)
class Attribute:
    """How one target attribute is made from source columns."""

    sources: tuple[str, ...] = ()
    relation: str = "one-to-one"
    merge_delimiter: str = " "
    split_delimiter: str | None = None
    take_first: bool = False
    take_index: int | None = None
    table_rules: dict[str, dict[str, Any]] = field(default_factory=dict)

    def for_table(self, table: str) -> Attribute:
        """The attribute with the rules of one table applied over the defaults."""
        known = ("relation", "merge_delimiter", "split_delimiter", "take_first", "take_index")
        own = {k: v for k, v in self.table_rules.get(table, {}).items() if k in known}
        return replace(self, **own)

    @property
    def is_list(self) -> bool:
        """True when the attribute keeps a whole list of tokens."""
        splits = self.relation == "one-to-many" and self.split_delimiter is not None
        return splits and not self.take_first and not _is_index(self.take_index)


def _is_index(value: Any) -> bool:
    return isinstance(value, int)


def parse_spec(spec: dict[str, Any]) -> dict[str, Attribute | None]:
    """Plain spec (as loaded from JSON) → attributes; entries of another kind → always null."""
    out: dict[str, Attribute | None] = {}
    for name, entry in spec.items():
        if isinstance(entry, list):
            out[name] = Attribute(tuple(entry))
        elif isinstance(entry, dict):
            known = {k: v for k, v in entry.items() if k in Attribute.__dataclass_fields__}
            known["sources"] = tuple(known.get("sources", ()))
            out[name] = Attribute(**known)
        else:
            out[name] = None
    return out


def split_source(source: str) -> tuple[str, str] | None:
    """``Table.Column`` → its parts; further dots belong to the column; no dot → ``None``."""
    table, dot, column = source.partition(".")
    return (table, column) if dot else None


def _source_columns(df: DataFrame, table: str, attribute: Attribute) -> list[Column]:
    """Text expressions of the attribute's columns in this table, null where there is no value."""
    found = []
    for source in attribute.sources:
        parts = split_source(source)
        if parts is None or parts[0] != table:
            continue
        match = next((f for f in df.schema.fields if f.name.strip() == parts[1]), None)
        if match is None:
            continue
        col = F.col("`" + match.name.replace("`", "``") + "`")
        if isinstance(match.dataType, T.ArrayType):
            found.append(F.when(F.size(col) > 0, list_literal(col.cast("array<string>"))))
        else:
            found.append(col.cast("string"))
    return found


def attribute_column(df: DataFrame, table: str, attribute: Attribute | None, as_list: bool = False) -> Column:
    """The attribute for one table, as text (or as list of text)."""
    nothing = F.lit(None).cast("array<string>" if as_list else "string")
    if attribute is None:
        return nothing
    rule = attribute.for_table(table)
    cols = _source_columns(df, table, rule)
    if not cols:
        # no value at all; a list attribute is then an empty list
        return F.array().cast("array<string>") if rule.is_list and as_list else nothing
    values = F.array_compact(F.array(*cols))
    merged = F.when(F.size(values) > 0, F.array_join(values, rule.merge_delimiter))
    if rule.relation in ("one-to-one", "many-to-one"):
        text = merged
    elif rule.relation == "one-to-many":
        if rule.split_delimiter is None:
            text = merged
        else:
            tokens = split_tokens(values, rule.split_delimiter)
            if _is_index(rule.take_index):
                text = F.get(tokens, F.lit(rule.take_index)) if rule.take_index >= 0 else F.lit(None)
            elif rule.take_first:
                text = F.get(tokens, F.lit(0))
            else:
                return tokens if as_list else list_literal(tokens)
    else:
        text = F.get(values, F.lit(0))
    text = text.cast("string")
    return F.when(text.isNotNull(), F.array(text)) if as_list else text


def split_tokens(values: Column, delimiter: str) -> Column:
    """All values split on the literal delimiter, tokens stripped, blanks dropped, in order."""
    pattern = literal_pattern(delimiter)

    def pieces(value: Column) -> Column:
        parts = F.transform(F.split(collapse_spaces(value), pattern, -1), strip)
        return F.filter(parts, lambda x: F.length(x) > 0)

    return F.flatten(F.transform(values, pieces))


def transform_table(
    df: DataFrame, table: str, spec: dict[str, Attribute | None], list_attributes: frozenset[str] | None = None
) -> DataFrame:
    """One source table → target attributes and the table's name. A single select."""
    lists = list_attributes_of(spec, [table]) if list_attributes is None else list_attributes
    cols = [attribute_column(df, table, a, name in lists).alias(name) for name, a in spec.items()]
    return df.select(*cols, F.lit(table).alias(SOURCE_COLUMN))


def list_attributes_of(spec: dict[str, Attribute | None], tables: list[str]) -> frozenset[str]:
    """Attributes that hold a list for at least one of the tables (one column has one type)."""
    return frozenset(n for n, a in spec.items() if a and any(a.for_table(t).is_list for t in tables))


def target_schema(spec: dict[str, Attribute | None], lists: frozenset[str] = frozenset()) -> T.StructType:
    text, many = T.StringType(), T.ArrayType(T.StringType())
    fields = [T.StructField(name, many if name in lists else text) for name in spec]
    return T.StructType([*fields, T.StructField(SOURCE_COLUMN, text)])


def populate(
    spark: SparkSession, tables: dict[str, DataFrame], spec: dict[str, Attribute | None]
) -> DataFrame:
    """The target table from all sources, in name order; no sources → the empty target table."""
    lists = list_attributes_of(spec, list(tables))
    if not tables:
        return spark.createDataFrame([], target_schema(spec, lists))
    parts = [transform_table(tables[name], name, spec, lists) for name in sorted(tables)]
    return append_tables(parts)


def append_tables(parts: list[DataFrame]) -> DataFrame:
    """Rows of all tables, columns matched by name, absent ones null, repeats kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_mediated(df: DataFrame, path: str) -> None:
    """All mediated rows in one write, a folder per source table."""
    df.write.mode("overwrite").partitionBy(SOURCE_COLUMN).parquet(path)


def mapping_rows(documents: DataFrame, col: str = "document") -> DataFrame:
    """Mapping documents (JSON, perhaps inside a code fence) → rows (attribute, table, column)."""
    bare = F.regexp_replace(strip(col), r"^```(json)?\s*|\s*```$", "")
    parsed = F.from_json(bare, T.MapType(T.StringType(), T.ArrayType(T.StringType())))
    rows = documents.select(F.explode_outer(parsed).alias("attribute", "_sources")).select(
        "attribute", F.explode("_sources").alias("_source")
    )
    dot = F.instr("_source", ".")
    return rows.filter(dot > 0).select(
        "attribute",
        F.substring(F.col("_source"), F.lit(1), dot - 1).alias("table"),
        F.substring(F.col("_source"), dot + 1, F.length("_source")).alias("column"),
    )


def spec_rows(spark: SparkSession, spec: dict[str, Attribute | None]) -> DataFrame:
    """The references of a spec as rows (attribute, table, column)."""
    rows = [
        (name, *parts)
        for name, a in spec.items()
        if a
        for parts in map(split_source, a.sources)
        if parts is not None
    ]
    return spark.createDataFrame(rows, "attribute string, `table` string, `column` string")


def coverage(catalog: DataFrame, references: DataFrame) -> DataFrame:
    """Every source column and every reference with its status (used, unused or dangling), the attributes
    that are mapped from it, and how many non-null values they can draw on."""
    used = references.groupBy("table", F.trim("column").alias("column")).agg(
        F.array_join(F.array_sort(F.collect_set("attribute")), ",").alias("attributes")
    )
    known = catalog.groupBy("table", F.trim("column").alias("column")).agg(F.sum("n_values").alias("n_values"))
    status = F.when(F.col("attributes").isNull(), "unused").when(F.col("n_values").isNull(), "dangling").otherwise("used")
    return known.join(used, ["table", "column"], "full_outer").select(
        "table", "column", status.alias("status"), F.coalesce("attributes", F.lit("")).alias("attributes"),
        F.coalesce("n_values", F.lit(0)).alias("n_values"),
    )
