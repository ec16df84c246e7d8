"""Samples and splits that depend on the rows alone, not on how they are partitioned.

The order of a sample is the order of ``md5(seed:id)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.ranking import rank_bands, row_index, sortable_long

SEED = 42


def hash_order(row_id: str | Column, seed: int = SEED) -> Column:
    text = (F.col(row_id) if isinstance(row_id, str) else row_id).cast("string")
    return F.md5(F.concat(F.lit(f"{seed}:"), text))


def _unique_order(row_id: str, seed: int) -> Column:
    return F.concat_ws(":", hash_order(row_id, seed), F.col(row_id).cast("string"))


def balanced(df: DataFrame, label: str, row_id: str, seed: int = SEED) -> DataFrame:
    """As many rows of every label as the rarest label has."""
    bands = rank_bands(df, label, _unique_order(row_id, seed), lambda sizes: [sizes.agg(F.min("n")).scalar()], "_band")
    return bands.filter("_band = 0").drop("_band")


def shuffled(df: DataFrame, row_id: str, seed: int = SEED) -> DataFrame:
    return df.orderBy(hash_order(row_id, seed), row_id)


def capped_negatives(df: DataFrame, label: str, row_id: str, times: int = 5, seed: int = SEED) -> DataFrame:
    """All rows of label 1 and at most ``times`` as many of label 0."""

    def room(sizes: DataFrame) -> list[Column]:
        positives = sizes.filter(F.col(label) == 1).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
        return [positives * times]

    bands = rank_bands(df.filter(F.col(label).isin(0, 1)), label, _unique_order(row_id, seed), room, "_band")
    return bands.filter((F.col(label) == 1) | (F.col("_band") == 0)).drop("_band")


def split_random(
    df: DataFrame, row_id: str, shares: dict[str, float] | None = None, seed: int = SEED
) -> DataFrame:
    """Row-local split by hash; the shares hold in expectation. No shuffle."""
    wanted = shares or {"train": 0.8, "valid": 0.1, "test": 0.1}
    spot = F.conv(F.substring(hash_order(row_id, seed), 1, 8), 16, 10).cast("double") / 2**32
    total, result = 0.0, None
    names = list(wanted)
    for name in names[:-1]:
        total += wanted[name]
        below = spot < F.lit(round(total, 12))
        result = F.when(below, name) if result is None else result.when(below, name)
    return df.withColumn("split", result.otherwise(names[-1]) if result is not None else F.lit(names[0]))


def split_exact(df: DataFrame, row_id: str, held_out: float = 0.2, seed: int = SEED) -> DataFrame:
    """Split with exact sizes: the held-out share, rounded up, is halved into valid and test."""
    return _split_by_rank(df, None, row_id, held_out, seed)


def split_stratified(df: DataFrame, label: str, row_id: str, held_out: float = 0.4, seed: int = SEED) -> DataFrame:
    """:func:`split_exact` inside every label."""
    return _split_by_rank(df, label, row_id, held_out, seed)


def _split_by_rank(df: DataFrame, label: str | None, row_id: str, held_out: float, seed: int) -> DataFrame:
    def cuts(sizes: DataFrame) -> list[Column]:
        held = F.ceil(F.round(F.col("n") * F.lit(held_out), 6))
        return [F.col("n") - held, F.col("n") - F.ceil(held / 2)]

    bands = rank_bands(df, label, _unique_order(row_id, seed), cuts, "_band")
    name = F.when(F.col("_band") == 0, "train").when(F.col("_band") == 1, "valid").otherwise("test")
    return bands.withColumn("split", name).drop("_band")


def split_modulo(df: DataFrame, index: str) -> DataFrame:
    """``index % 3``: 0 → test, 1 → valid, all else (a missing index too) → train."""
    rest = F.pmod(F.col(index), F.lit(3))
    return df.withColumn("split", F.when(rest == 0, "test").when(rest == 1, "valid").otherwise("train"))


def label_not_null(df: DataFrame, col: str, label: str = "label") -> DataFrame:
    return df.withColumn(label, F.col(col).isNotNull().cast("int"))


def every_nth(df: DataFrame, order: list[str], n: int = 12, stop_after: int | None = None) -> DataFrame:
    """Every ``n``-th row, the first one included; of the first ``stop_after`` rows if that is given."""
    if stop_after is not None:
        numbered = df.orderBy(*order).limit(stop_after).withColumn("_at", F.row_number().over(Window.orderBy(*order)))
        return numbered.filter((F.col("_at") - 1) % n == 0).drop("_at")
    keys = [_sortable(df, c) for c in order]
    return row_index(df, *keys, out="_at").filter(F.col("_at") % n == 0).drop("_at")


def _sortable(df: DataFrame, col: str) -> Column:
    """A text that sorts like ``col``, for whole numbers and texts."""
    kind = dict(df.dtypes)[col]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return sortable_long(col)
    if kind != "string":
        raise ValueError(f"cannot number rows in the order of {col!r} ({kind})")
    return F.col(col)


def top_pairs(pairs: DataFrame, score: str, k: int | None = None) -> DataFrame:
    """Pairs from the best score down, ties in id order; the ``k`` best if that is given."""
    ordered = pairs.orderBy(F.desc(score), "id_left", "id_right")
    return ordered if k is None else ordered.limit(k)
