"""Joins by id and by pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.cleaning import pair_key
from kindred.session import cut_lineage


HOT_ROWS = 1_000_000  # a key with more rows than this on a side is not joined in one task
MOST_PARTS = 512


def outer_chain(tables: list[DataFrame], key: str, suffixes: tuple[str, str] = ("_x", "_y"), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Full outer joins one after another on ``key``; a missing key matches a missing key.

    Columns that both sides have get the suffixes. Keys with more than ``hot_rows`` rows on a side, the missing
    key among them, are taken apart, see :func:`_full_outer`.
    """

    def merge(left: DataFrame, right: DataFrame) -> DataFrame:
        shared = ({*left.columns} & {*right.columns}) - {key}
        a = left.withColumnsRenamed({c: c + suffixes[0] for c in shared}).withColumnRenamed(key, "_left_key")
        b = right.withColumnsRenamed({c: c + suffixes[1] for c in shared}).withColumnRenamed(key, "_right_key")
        # written, as it is read for the hot keys and for the join
        joined = _full_outer(cut_lineage(a) if left is not tables[0] else a, b, hot_rows)
        merged = F.coalesce("_left_key", "_right_key").alias(key)
        rest = [c for c in [*a.columns, *b.columns] if c not in ("_left_key", "_right_key")]
        return joined.select(merged, *rest)

    return reduce(merge, tables)


def _full_outer(a: DataFrame, b: DataFrame, hot_rows: int) -> DataFrame:
    """Full outer join on ``_left_key`` and ``_right_key``, null with null.

    Keys of ``a`` with many rows: ``a``'s rows are dealt over as many parts as the key needs, and ``b``'s rows of the
    key are copied to every part; the other way round for ``b``, and over a grid of parts where both sides have many.
    Rows that meet none are kept once: they are found by an anti join against the other side's distinct keys.
    """
    same = F.col("_left_key").eqNullSafe(F.col("_right_key"))
    hot = cut_lineage(_hot_keys(a, b, hot_rows))
    if hot.isEmpty():
        return a.join(b, same, "full_outer")
    # as many keys at most as the rows of both sides by ``hot_rows``; without a hint the size of the table decides
    known = hot.select(F.col("key").alias("_hot"), "_rows", "_columns")

    def apart(side: DataFrame, own: str) -> tuple[DataFrame, DataFrame]:
        is_hot = F.col(own).eqNullSafe(F.col("_hot"))
        return side.join(known, is_hot, "left_anti"), side.join(known, is_hot).drop("_hot")

    a_rest, a_hot = apart(a, "_left_key")
    b_rest, b_hot = apart(b, "_right_key")
    rest = a_rest.join(b_rest, same, "full_outer")
    # both sides are written, so where a row goes is settled; a hot key is in a cell of its grid once per row and column
    spread = lambda parts: F.floor(F.rand(11) * F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = cut_lineage(a_hot.withColumn("_r", spread("_rows"))).withColumn("_c", every("_columns")).drop("_rows", "_columns")
    right = cut_lineage(b_hot.withColumn("_c2", spread("_columns"))).withColumn("_r2", every("_rows")).drop("_rows", "_columns")
    cell = same & (F.col("_r") == F.col("_r2")) & (F.col("_c") == F.col("_c2"))
    met = left.join(right, cell).drop("_r", "_r2", "_c", "_c2")
    # hot keys that one side lacks
    left_only = a_hot.drop("_rows", "_columns").join(b_hot.select("_right_key").distinct(), same, "left_anti")
    right_only = b_hot.drop("_rows", "_columns").join(a_hot.select("_left_key").distinct(), same, "left_anti")
    found = rest.unionByName(met)
    for alone in (left_only, right_only):
        found = found.unionByName(alone, allowMissingColumns=True)
    return found.select(*a.columns, *b.columns)


def _hot_keys(a: DataFrame, b: DataFrame, hot_rows: int) -> DataFrame:
    """``key`` of the hot keys, into how many parts each side's rows of it are dealt: ``_rows`` and ``_columns``."""

    def counted(side: DataFrame, key: str) -> DataFrame:
        return side.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)

    parts = lambda n: F.least(F.coalesce(F.ceil(F.col(n) / hot_rows), F.lit(1)), F.lit(MOST_PARTS)).cast("int")
    left = counted(a, "_left_key").withColumnsRenamed({"key": "_lk", "n": "_ln"})
    right = counted(b, "_right_key").withColumnsRenamed({"key": "_rk", "n": "_rn"})
    # flags, since the missing key is a key too
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), F.col("_lk").eqNullSafe(F.col("_rk")), "full_outer")
    return both.select(F.when(F.col("_l").isNotNull(), F.col("_lk")).otherwise(F.col("_rk")).alias("key"), parts("_ln").alias("_rows"), parts("_rn").alias("_columns"))


def lookup_pairs(pairs: DataFrame, table_a: DataFrame, table_b: DataFrame, text_a: Column, text_b: Column) -> DataFrame:
    """Labelled id pairs with the texts of both sides; an id that is not found gives ``''``."""
    a = table_a.select(F.col("id").alias("ltable_id"), text_a.alias("sentence1"))
    b = table_b.select(F.col("id").alias("rtable_id"), text_b.alias("sentence2"))
    joined = pairs.join(a, "ltable_id", "left").join(b, "rtable_id", "left")
    empty = F.lit("")
    return joined.select(
        F.col("ltable_id").alias("id"),
        F.coalesce("sentence1", empty).alias("sentence1"),
        F.coalesce("sentence2", empty).alias("sentence2"),
        "label",
    )


def lookup_pairs_strict(
    pairs: DataFrame, table_a: DataFrame, table_b: DataFrame, text_a: Column, text_b: Column, order: str
) -> DataFrame:
    """As :func:`lookup_pairs`, ids compared as text, first row of an id used, a missing id fails.

    ``order`` says which row of an id is the first.
    """

    def side(table: DataFrame, text: Column, key: str, name: str) -> DataFrame:
        first = F.min_by(F.struct(text.alias("text")), F.col(order))
        return table.groupBy(F.col("id").cast("string").alias(key)).agg(first.alias(name))

    keyed = pairs.withColumns({"_l": F.col("ltable_id").cast("string"), "_r": F.col("rtable_id").cast("string")})
    joined = keyed.join(side(table_a, text_a, "_l", "_a"), "_l", "left").join(
        side(table_b, text_b, "_r", "_b"), "_r", "left"
    )
    missing = F.raise_error(F.concat(F.lit("no row for pair "), "_l", F.lit(" / "), "_r"))
    found = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    # the check is part of an output column, so it cannot be pruned away
    return joined.select(
        *pairs.columns,
        F.when(found, F.col("_a.text")).otherwise(missing.cast("string")).alias("text_left"),
        F.when(found, F.col("_b.text")).otherwise(missing.cast("string")).alias("text_right"),
    )


def with_pair_key(df: DataFrame, left: str | Column, right: str | Column) -> DataFrame:
    lo, hi = pair_key(left, right)
    return df.withColumns({"pair_lo": lo, "pair_hi": hi})


def distinct_pairs(df: DataFrame) -> DataFrame:
    return df.select("pair_lo", "pair_hi").distinct()


def pairs_in(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows whose pair is also in ``other``."""
    return df.join(distinct_pairs(other), ["pair_lo", "pair_hi"], "left_semi")


def intersect_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    return distinct_pairs(a).join(distinct_pairs(b), ["pair_lo", "pair_hi"], "left_semi")


def union_pairs(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [s.select("pair_lo", "pair_hi") for s in sets]).distinct()


def label_membership(df: DataFrame, truth: DataFrame, label: str = "label") -> DataFrame:
    """1 when the pair is in ``truth``, whatever its label there, else 0."""
    known = distinct_pairs(truth).withColumn("_in", F.lit(1))
    marked = df.join(known, ["pair_lo", "pair_hi"], "left")
    return marked.withColumn(label, F.coalesce("_in", F.lit(0))).drop("_in")
