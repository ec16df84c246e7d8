"""Exact duplicates by deterministic block naming, in DataFrame operations only.

Every text is cut into blocks of a fixed number of characters. The distinct blocks are sorted and
numbered, so that two blocks have the same integer name exactly when they are the same string; no
fingerprint decides anything. Adjacent names are paired, the distinct pairs are sorted and numbered
in the same way, and so on until every document has one name. Documents are equal exactly when
both their number of blocks and their last name are equal.

Names are dense ranks inside buckets. A bucket holds the values of one hash residue, and the name
is ``rank * buckets + bucket``: unique over all buckets without a global sort. Equal values are
combined on the map side before any shuffle, in lists that a salt keeps short, so a block shared
by a third of all documents crosses the network once per task and salt, not once per document.

Defined results: a null text is the empty text, which is one empty block; repeated rows, also with
the same id, count as members of their group and one of them stays; a null id loses against any
other id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.session import cut_lineage

BLOCK_CHARS = 4096
SALTS = 64  # at least; they grow with the shuffle setting, that is with the data


def _named(rows: DataFrame, value: list[str], buckets: int) -> DataFrame:
    """``rows`` with ``value`` replaced by one integer ``name``: equal names for equal values."""
    others = [c for c in rows.columns if c not in value]
    short = rows.select(
        *value, F.pmod(F.xxhash64("rid"), F.lit(max(SALTS, buckets))).alias("_salt"), F.struct(*others).alias("_row")
    )
    distinct = (
        short.groupBy(*value, "_salt")
        .agg(F.collect_list("_row").alias("_rows"))
        .withColumn("_bucket", F.pmod(F.xxhash64(*value), F.lit(buckets)))
    )
    rank = F.dense_rank().over(Window.partitionBy("_bucket").orderBy(*value)).cast("long")
    return (
        distinct.withColumn("name", rank * buckets + F.col("_bucket"))
        .select("name", F.explode("_rows").alias("_row"))
        .select("name", "_row.*")
    )


def _blocks(text: Column, block_chars: int) -> Column:
    """The blocks of a text, in time proportional to its length; one empty block without text."""
    found = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(found)


def block_identity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs``: ``rid``, the id, ``text_sha256``, ``n_blocks`` and ``name``.

    Rows have equal texts exactly when ``n_blocks`` and ``name`` are equal. The digest is a by-product.
    """
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    blocks = rows.select(
        "rid", "id", F.sha2("text", 256).alias("sha"), _blocks(F.col("text"), block_chars).alias("blocks")
    ).select("rid", "id", "sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("idx", "block"))
    first = F.col("idx") == 0
    level = cut_lineage(
        _named(
            blocks.select("rid", F.when(first, F.col("id")).alias("id"), F.when(first, F.col("sha")).alias("sha"), "n", "idx", "block"),
            ["block"],
            buckets,
        )
    )
    heads = level.where("idx = 0")
    done = heads.where("n = 1").select("rid", "id", "sha", "n", "name")
    most = level.agg(F.max("n")).first()[0] or 1
    current = level.where("n > 1").select("rid", "idx", "name")
    while most > 1:
        pairs = current.groupBy("rid", F.expr("idx div 2").cast("int").alias("idx")).agg(
            F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"),
            F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))).alias("b"),
        )
        current = cut_lineage(_named(pairs, ["a", "b"], buckets))
        most = (most + 1) // 2
    long_ones = heads.where("n > 1").drop("name").join(current.select("rid", "name"), "rid")
    return done.unionByName(long_ones.select("rid", "id", "sha", "n", "name")).select(
        "rid", F.col("id").alias(id_col), F.col("sha").alias("text_sha256"), F.col("n").alias("n_blocks"), "name"
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of ``docs``: the id, ``keep_id`` (the largest id of its group), ``group_size``,
    ``kept`` (true for one row of each group) and ``text_sha256``."""
    ident = cut_lineage(block_identity(docs, id_col, text_col, block_chars))
    key = ["n_blocks", "name"]
    groups = cut_lineage(
        ident.groupBy(*key)
        .agg(F.max(F.struct(id_col, "rid")).alias("_keep"), F.count(F.lit(1)).alias("_size"))
        .where("_size > 1")
    )
    joined = ident.join(groups, key, "left")
    alone = F.col("_keep").isNull()
    return joined.select(
        F.col(id_col),
        F.when(alone, F.col(id_col)).otherwise(F.col(f"_keep.{id_col}")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_keep.rid") == F.col("rid"))).alias("kept"),
        "text_sha256",
    )
