"""Global ranks without a global window.

A window without a partition sorts the whole table in one task. Here the order key is cut at
split points, each range is ranked on its own, and the sizes of the earlier ranges are added.
Split points come from a sample of bounded size; any split points give the right ranks, they
only decide how even the ranges are. Order keys are unique (see :func:`order_key`), so one
value held by a third of all rows is spread over several ranges too.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.cleaning import as_column
from kindred.session import cut_lineage

SAMPLE_PER_RANGE = 24
POINT_CHARS, MOST_POINT_CHARS = 256, 1 << 16
SAMPLE_CHARS = 1 << 22
PREFIX_DIGITS = 4  # a class is counted in 16^4 parts by the first digits of its hash order
MAX_CLASSES = 10_000
_GROUP = 32
_CUT = "\x01"


def order_key(*cols: Column) -> Column:
    """One text that sorts like the given text columns one after another."""
    return F.concat_ws("\x00", *[as_column(c) for c in cols])


def sortable_long(c: Column | str) -> Column:
    """A whole number as fixed-width text with the same order."""
    shifted = as_column(c).cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")
    return F.lpad(shifted.cast("decimal(20,0)").cast("string"), 20, "0")


def ranges_for(df: DataFrame) -> int:
    """As many ranges as a shuffle has partitions: the setting that follows the size of the data."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _told_apart(before: str, key: str) -> str:
    """The shortest beginning of ``key`` that sorts after ``before``."""
    same = next((k for k, (x, y) in enumerate(zip(before, key, strict=False)) if x != y), min(len(before), len(key)))
    return key[: same + 1]


def split_points(df: DataFrame, key: str, ranges: int) -> list[str]:
    """Split points of ``key``: beginnings of the keys of the rows with the smallest hashes.

    The sample is bounded in rows and in bytes: of every key the first ``POINT_CHARS`` characters are read, and four
    times as many, up to ``MOST_POINT_CHARS``, as long as different keys begin alike. A point is as long as it must
    be to differ from the sampled key before it. Where a key holds the character that separates points in the
    plan, the part before it is the point.
    """
    rows, width = ranges * SAMPLE_PER_RANGE, POINT_CHARS
    smallest = df.select(key).filter(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key)
    while True:
        sample = smallest.limit(rows).select(F.substring(key, 1, width), F.xxhash64(key)).collect()
        keys = sorted({row[0].split(_CUT)[0] for row in sample}, key=lambda k: k.encode())
        if 2 * len(keys) >= len({row[1] for row in sample}) or width >= MOST_POINT_CHARS:
            break
        width = 4 * width
        rows = max(2 * ranges, min(rows, SAMPLE_CHARS // width))
    if not keys:
        return []
    step = len(keys) / ranges
    chosen = {_told_apart(keys[at - 1] if at else "", keys[at]) for at in (int(k * step) for k in range(1, ranges))}
    return sorted(chosen, key=lambda k: k.encode())


def range_of(key: Column, points: list[str]) -> Column:
    """Number of split points at or below ``key``: a coarse count, then a count in one group."""
    if not points:
        return F.lit(0)

    def constant(items: list[str]) -> Column:
        return F.split(F.lit(_CUT.join(items)), _CUT, -1)

    def at_or_below(items: Column) -> Column:
        return F.size(F.filter(items, lambda p: p <= key))

    if len(points) <= _GROUP:
        return at_or_below(constant(points))
    heads = points[_GROUP - 1 :: _GROUP]
    group = at_or_below(constant(heads))
    return group * _GROUP + at_or_below(F.slice(constant(points), group * _GROUP + 1, F.lit(_GROUP)))


def global_row_number(df: DataFrame, key: str, out: str = "rank") -> DataFrame:
    """Add the 1-based position of every row in the order of ``key`` (a unique text column)."""
    points = split_points(df, key, ranges_for(df))
    ranged = df.withColumn("_range", range_of(F.col(key), points))
    # one number per range, so they may be part of the plan
    sizes = df.select(range_of(F.col(key), points).alias("_range")).groupBy("_range").count().collect()
    counted = {r["_range"]: r["count"] for r in sizes}
    before = [0, *accumulate(counted.get(k, 0) for k in range(len(points)))]
    inside = Window.partitionBy("_range").orderBy(key)
    offset = F.get(F.array(*[F.lit(n).cast("long") for n in before]), F.col("_range"))
    return ranged.withColumn(out, (F.row_number().over(inside) + offset).cast("long")).drop("_range")


def rank_values(df: DataFrame, col: str, out: str = "rank") -> DataFrame:
    """Distinct values of ``col`` with their rows counted and their dense rank (nulls left out)."""
    values = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))
    return global_row_number(cut_lineage(values), col, out)  # the values are read three times


def row_index(df: DataFrame, *order: Column | str, out: str = "row_id") -> DataFrame:
    """Sequential 0-based row id in the given order (unique together)."""
    keyed = df.withColumn("_key", order_key(*order))
    return global_row_number(keyed, "_key", out).withColumn(out, F.col(out) - 1).drop("_key")


def rank_within(df: DataFrame, group: str, order: Column, out: str = "rank", size: str | None = None) -> DataFrame:
    """Position inside each class, exact also when one class holds most of the rows.

    The global position in (class, order) minus the rows of the classes before. ``order`` is text
    and unique inside a class; ``size`` names a column for the number of rows of the class.
    """
    name = F.coalesce(F.col(group).cast("string"), F.lit(""))
    numbered = global_row_number(df.withColumn("_key", order_key(name, order)), "_key", "_position").drop("_key")
    sizes = cut_lineage(df.groupBy(name.alias("_class")).agg(F.count(F.lit(1)).alias("_size")))
    if sizes.limit(MAX_CLASSES + 1).count() <= MAX_CLASSES:
        before = Window.orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
        classes = F.broadcast(sizes.select("_class", "_size", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")))
    else:  # a class begins where its smallest position is
        numbered = cut_lineage(numbered)
        first = numbered.groupBy(name.alias("_class")).agg((F.min("_position") - 1).alias("_start"))
        classes = cut_lineage(first.join(sizes, "_class"))
    joined = numbered.withColumn("_class", name).join(classes, "_class")
    ranked = joined.withColumn(out, F.col("_position") - F.col("_start"))
    if size:
        ranked = ranked.withColumn(size, F.col("_size"))
    return ranked.drop("_class", "_size", "_start", "_position")


def rank_bands(df: DataFrame, group: str | None, order: Column, cuts: Callable[[DataFrame], list[Column]], out: str = "band") -> DataFrame:
    """Which of the ranks ``cuts`` (ascending) a row's rank inside its class exceeds: 0 for none, 1 for the first, ...

    ``order`` is a text that is unique inside a class and begins with evenly spread hexadecimal digits (a hash). Nothing
    is sorted as a whole: rows are counted by class and first digits, which tells in which part of a class a cut
    falls, and only the rows of those parts are ranked. ``cuts`` gives expressions over ``n``, the rows of the class;
    it is handed the table of ``n`` per class for sizes of other classes.
    """
    name = F.col(group) if group else F.lit(0)
    rows = df.withColumns({"_class": name, "_order": order}).withColumn("_part", F.substring("_order", 1, PREFIX_DIGITS))
    # a written table of at most 16^4 rows per class; copies of a class are combined before they move
    counts = cut_lineage(rows.groupBy("_class", "_part").agg(F.count(F.lit(1)).alias("_rows")))
    sizes = counts.groupBy("_class").agg(F.sum("_rows").alias("n"))
    wanted = cuts(sizes.withColumnRenamed("_class", group) if group else sizes)
    upto = Window.partitionBy("_class").orderBy("_part")
    placed = counts.withColumns({"_upto": F.sum("_rows").over(upto), "n": F.sum("_rows").over(Window.partitionBy("_class"))})
    # of every cut the part it falls into and how many of that part's rows come before it
    every = placed.select("_class", "_part", "_rows", "_upto", F.posexplode(F.array(*[c.cast("long") for c in wanted])).alias("_k", "_cut"))
    met = every.where("_upto >= _cut").groupBy("_class", "_k").agg(
        F.min(F.struct("_part", (F.col("_cut") - F.col("_upto") + F.col("_rows")).alias("inside"), F.col("_rows").alias("rows"))).alias("at")
    )
    bounds = cut_lineage(met.groupBy("_class").agg(F.collect_list("at").alias("_bounds")).withColumnRenamed("_class", "_of"))
    if group is None:  # one class: a few numbers, which may be part of the plan
        at = [b for row in bounds.collect() for b in row["_bounds"]]
        fixed = F.array(*[F.struct(*[F.lit(b[c]).alias(c) for c in ("_part", "inside", "rows")]) for b in at])
        joined = rows.withColumn("_bounds", fixed if at else F.lit(None).cast(bounds.schema["_bounds"].dataType))
    else:
        if bounds.limit(MAX_CLASSES + 1).count() <= MAX_CLASSES:
            bounds = F.broadcast(bounds)
        joined = rows.join(bounds, F.col("_class").eqNullSafe(F.col("_of")), "left").drop("_of")
    part = F.col("_part")
    tied = F.coalesce(F.exists("_bounds", lambda b: (b["_part"] == part) & (b["inside"] > 0) & (b["inside"] < b["rows"])), F.lit(False))

    def beyond(rank: Column | None) -> Column:
        def passed(b: Column) -> Column:
            here = b["inside"] <= 0 if rank is None else b["inside"] < rank
            return (part > b["_part"]) | ((part == b["_part"]) & here)

        return F.when(F.col("_bounds").isNull(), 0).otherwise(F.size(F.filter("_bounds", passed)))

    whole = joined.filter(~tied).withColumn(out, beyond(None))
    rank = F.row_number().over(Window.partitionBy("_class", "_part").orderBy("_order"))
    cut = joined.filter(tied).withColumn("_rank", rank).withColumn(out, beyond(F.col("_rank"))).drop("_rank")
    return whole.unionByName(cut).drop("_class", "_order", "_part", "_bounds")
