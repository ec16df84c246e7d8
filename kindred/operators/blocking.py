"""Candidate generation.

A candidate set is kept as members of blocks (one row per record and block), which grows with
the records. The pairs of a block grow with its square, so they come into being only inside
:func:`kindred.operators.pairjoin.similar_pairs`, where those failing the rule are dropped at
once. How many pairs a candidate set stands for is counted from block sizes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.cleaning import first_letter, strip
from kindred.operators.ranking import global_row_number, order_key, rank_values, sortable_long
from kindred.session import cut_lineage


@dataclass(frozen=True)
class Block:
    """Records that share a value. Blank values are no key unless asked for."""

    col: str
    keep_blank: bool = False

    def key(self):
        return F.col(self.col).cast("string")

    def members(self, df: DataFrame) -> DataFrame:
        key = self.key()
        if not self.keep_blank:
            key = F.when(strip(key) != "", key)
        named = F.concat(F.lit(f"{type(self).__name__}:{self.col}="), key)
        return df.withColumns({"block": named, "anchor": F.lit(True)}).filter(F.col("block").isNotNull())

    def placed(self, df: DataFrame, out: str) -> DataFrame:
        """Add where a row stands: its key."""
        key = self.key()
        return df.withColumn(out, key if self.keep_blank else F.when(strip(key) != "", key))

    def entries(self, place: str) -> Column:
        """Blocks of a placed row, each with whether the row is an anchor of it."""
        entry = F.struct(F.col(place).cast("string").alias("block"), F.lit(True).alias("anchor"))
        return F.when(F.col(place).isNotNull(), F.array(entry))


@dataclass(frozen=True)
class FirstLetter(Block):
    """Records whose value starts with the same character."""

    def key(self):
        return first_letter(self.col)


@dataclass(frozen=True)
class Neighbourhood:
    """Records whose values are at most ``(window - 1) / 2`` apart in sorted order.

    Values, not records, are ranked. The record of rank r is a member of the blocks r, r-1, …;
    a pair counts in the block of its smaller rank, whose records are the anchors.
    """

    col: str
    window: int = 5

    def __post_init__(self) -> None:
        if self.window < 1 or self.window % 2 == 0:
            raise ValueError("window must be odd")

    @property
    def reach(self) -> int:
        return (self.window - 1) // 2

    def members(self, df: DataFrame) -> DataFrame:
        ranks = rank_values(df, self.col, "_rank").select(F.col(self.col).alias("_value"), "_rank")
        return (
            df.join(ranks, F.col(self.col) == F.col("_value"))
            .withColumn("_back", F.explode(F.sequence(F.lit(0), F.lit(self.reach))))
            .withColumn("_first", F.col("_rank") - F.col("_back"))
            .filter("_first >= 1")
            .withColumns(
                {
                    "block": F.concat(F.lit(f"Neighbourhood:{self.col}="), F.col("_first").cast("string")),
                    "anchor": F.col("_back") == 0,
                }
            )
            .drop("_value", "_rank", "_back", "_first")
        )

    def placed(self, df: DataFrame, out: str) -> DataFrame:
        """Add where a row stands: the rank of its value."""
        ranks = rank_values(df, self.col, out).select(F.col(self.col).alias("_value"), out)
        return df.join(ranks, F.col(self.col) == F.col("_value"), "left").drop("_value")

    def entries(self, place: str) -> Column:
        """See :meth:`Block.entries`."""
        first = F.filter(F.sequence(F.col(place) - self.reach, F.col(place)), lambda x: x >= 1)
        return F.transform(first, lambda x: F.struct(x.cast("string").alias("block"), (x == F.col(place)).alias("anchor")))


@dataclass(frozen=True)
class Given:
    """Blocks computed elsewhere: ``members`` has the values of ``col`` and a ``key`` (repeats allowed)."""

    members_of: DataFrame
    col: str

    def members(self, df: DataFrame) -> DataFrame:
        named = self.members_of.select(
            F.col(self.col).alias("_value"), F.concat(F.lit(f"Given:{self.col}="), F.col("key")).alias("block")
        )
        joined = df.join(named, F.col(self.col) == F.col("_value")).drop("_value")
        return joined.withColumn("anchor", F.lit(True))

    def placed(self, df: DataFrame, out: str) -> DataFrame:
        """Add where a row stands: its keys."""
        named = self.members_of.select(F.col(self.col).alias("_value"), F.col("key").cast("string").alias("_key")).dropna()
        keys = named.groupBy("_value").agg(F.sort_array(F.collect_set("_key")).alias(out))
        return df.join(keys, F.col(self.col) == F.col("_value"), "left").drop("_value")

    def entries(self, place: str) -> Column:
        """See :meth:`Block.entries`."""
        return F.transform(place, lambda k: F.struct(k.alias("block"), F.lit(True).alias("anchor")))

    def single(self, out: str) -> DataFrame:
        """``_value`` and its one key; blocks that overlap have no such form and are refused."""
        keys = cut_lineage(self.members_of.select(F.col(self.col).alias("_value"), F.col("key").alias(out)).dropna().distinct())
        if not keys.groupBy("_value").count().where("count > 1").isEmpty():
            raise ValueError(f"values of {self.col!r} are in several given blocks: their pairs cannot be counted from sizes")
        return keys


Indexer = Block | Neighbourhood | Given


def block_members(df: DataFrame, indexers: list[Indexer]) -> DataFrame:
    """Members of the blocks of several indexers; a candidate pair shares at least one block."""
    return reduce(DataFrame.unionByName, [ix.members(df) for ix in indexers])


def placed_members(df: DataFrame, indexers: list[Indexer]) -> tuple[DataFrame, DataFrame, dict[str, int | None]]:
    """Members of blocks that know where they stand in every blocking, their blocks alone, and the names of the places.

    The places are ``_in0``, ``_in1``, ... with the reach of a neighbourhood (otherwise None); ``_of`` is the number of
    the blocking. The rows are written once, with a row per record; members come into being as they are read.
    """
    places = {f"_in{k}": ix.reach if isinstance(ix, Neighbourhood) else None for k, ix in enumerate(indexers)}
    placed = cut_lineage(reduce(lambda out, at: at[1].placed(out, at[0]), zip(places, indexers, strict=True), df))
    # equal keys of different blockings are different blocks
    entries, named = [], {}
    for k, (ix, place) in enumerate(zip(indexers, places, strict=True)):
        entries.append(_named_entries(ix.entries(place), k))
        if isinstance(ix, Given):  # a row is in several of its blocks
            named[place] = _named_keys(F.col(place), k)
    exploded = F.explode(F.concat(*entries)).alias("_m")
    members = placed.select(*df.columns, *places, exploded).withColumns(named).select(*df.columns, *places, "_m.*")
    return members, placed.select(exploded).select("_m.block"), places


def _named_entries(entries: Column, k: int) -> Column:
    named = F.transform(entries, lambda e: F.struct(F.concat(F.lit(f"{k}:"), e["block"]).alias("block"), e["anchor"].alias("anchor"), F.lit(k).alias("_of")))
    return F.coalesce(named, F.array().cast("array<struct<block:string,anchor:boolean,_of:int>>"))


def _named_keys(keys: Column, k: int) -> Column:
    return F.coalesce(F.transform(keys, lambda key: F.concat(F.lit(f"{k}:"), key)), F.array().cast("array<string>"))


def exact_blocks(df: DataFrame, cols: list[str], row_id: str = "rec_id") -> DataFrame:
    """Members of exact-key blocks with the size of their block; rows with a null key left out.

    The sizes are a written table: so neither side of the join comes partitioned by an aggregation,
    and adaptive execution can split a hot block.
    """
    keyed = df.select(row_id, *cols).dropna(subset=cols)
    sizes = keyed.groupBy(*cols).agg(F.count(F.lit(1)).alias("block_size")).filter("block_size > 1")
    return keyed.join(cut_lineage(sizes), cols).select(row_id, *cols, "block_size")


def block_sizes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per block its records and the candidate pairs it stands for."""
    n = F.col("n_records").cast("decimal(38,0)")
    return (
        df.dropna(subset=cols)
        .groupBy(*cols)
        .agg(F.count(F.lit(1)).alias("n_records"))
        .withColumn("n_pairs", (n * (n - 1) / 2).cast("decimal(38,0)"))
    )


def neighbour_values(df: DataFrame, col: str, window: int = 5) -> DataFrame:
    """Sorted neighbourhood by value: value pairs up to the reach apart, each with its record pairs.

    Distance 0 stands for the records of one value. Grows with the number of distinct values.
    """
    reach = Neighbourhood(col, window).reach
    ranks = rank_values(df, col, "rank")
    left = ranks.select(
        F.col(col).alias("value_left"), F.col("rank").alias("rank_left"), F.col("n_rows").alias("n_left")
    ).withColumn("distance", F.explode(F.sequence(F.lit(0), F.lit(reach))))
    right = ranks.select(
        F.col(col).alias("value_right"), F.col("rank").alias("rank_right"), F.col("n_rows").alias("n_right")
    )
    paired = left.join(right, F.col("rank_left") + F.col("distance") == F.col("rank_right"))
    a, b = F.col("n_left").cast("decimal(38,0)"), F.col("n_right").cast("decimal(38,0)")
    pairs = F.when(F.col("distance") == 0, a * (a - 1) / 2).otherwise(a * b)
    return paired.withColumn("n_pairs", pairs.cast("decimal(38,0)")).filter("n_pairs > 0")


def neighbour_rows(df: DataFrame, col: str, row_id: str = "rec_id", reach: int = 2) -> DataFrame:
    """Sorted neighbourhood by record: each record with the next ``reach`` ones in (col, id) order."""
    ranked = _ranked_rows(df, col, row_id)
    left = ranked.select(F.col(row_id).alias("_a"), F.col("rank").alias("rank_left")).withColumn(
        "distance", F.explode(F.sequence(F.lit(1), F.lit(reach)))
    )
    right = ranked.select(F.col(row_id).alias("_b"), F.col("rank").alias("_rank_right"))
    return left.join(right, F.col("rank_left") + F.col("distance") == F.col("_rank_right")).select(
        F.least("_a", "_b").alias("id_left"), F.greatest("_a", "_b").alias("id_right"), "rank_left", "distance"
    )


def adjacent_rows(df: DataFrame, col: str, row_id: str = "rec_id", cols: list[str] | None = None) -> DataFrame:
    """Every record beside the next one in (col, id) order; the last one has no partner."""
    wanted = cols or [row_id, col]
    ranked = global_row_number(
        df.select(*{*wanted, col, row_id}).dropna(subset=[col]).withColumn(
            "_key", order_key(F.col(col), sortable_long(row_id))
        ),
        "_key",
    ).drop("_key")
    first = ranked.select("rank", *[F.col(c).alias(f"{c}_left") for c in wanted])
    second = ranked.select((F.col("rank") - 1).alias("rank"), *[F.col(c).alias(f"{c}_right") for c in wanted])
    return first.join(second, "rank")


def _ranked_rows(df: DataFrame, col: str, row_id: str) -> DataFrame:
    keyed = df.select(row_id, col).dropna(subset=[col])
    return global_row_number(
        keyed.withColumn("_key", order_key(F.col(col), sortable_long(row_id))), "_key"
    ).drop("_key")


def candidate_count(df: DataFrame, indexers: list[Indexer]) -> DataFrame:
    """Number of distinct pairs in the union of the indexers, as one row ``n_candidates``.

    Given blocks must not overlap. Counted by inclusion and exclusion: the pairs common to some indexers are the pairs of the
    groups that share all their keys (ranks up to the reach apart), so only group sizes are
    needed and no pair is made.
    """
    ranked = df
    for at, ix in enumerate(indexers):
        if isinstance(ix, Neighbourhood):
            ranks = rank_values(df, ix.col, f"_k{at}").select(F.col(ix.col).alias("_value"), f"_k{at}")
            ranked = ranked.join(ranks.hint("merge"), F.col(ix.col) == F.col("_value"), "left").drop("_value")
        elif isinstance(ix, Given):
            ranked = ranked.join(ix.single(f"_k{at}"), F.col(ix.col) == F.col("_value"), "left").drop("_value")
        else:
            key = ix.key()
            ranked = ranked.withColumn(f"_k{at}", key if ix.keep_blank else F.when(strip(key) != "", key))
    keys = [f"_k{at}" for at in range(len(indexers))]
    # every count below is a sum over these groups, so the records are read once
    base = cut_lineage(ranked.groupBy(*keys).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n")))
    terms = []
    for size in range(1, len(indexers) + 1):
        for chosen in combinations(range(len(indexers)), size):
            sign = 1 if size % 2 else -1
            terms.append(_common_pairs(base, indexers, chosen).select((F.lit(sign) * F.col("pairs")).alias("pairs")))
    total = reduce(DataFrame.unionByName, terms)
    return total.agg(F.sum("pairs").cast("decimal(38,0)").alias("n_candidates"))


def _common_pairs(base: DataFrame, indexers: list[Indexer], chosen: tuple[int, ...]) -> DataFrame:
    keys = [f"_k{at}" for at in chosen]
    groups = base.dropna(subset=keys).groupBy(*keys).agg(F.sum("n").cast("decimal(38,0)").alias("n"))
    moved = groups
    for at in chosen:
        if isinstance(indexers[at], Neighbourhood):
            reach = indexers[at].reach
            moved = moved.withColumn("_d", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn(
                f"_k{at}", F.col(f"_k{at}") + F.col("_d")
            ).drop("_d")
    # both sides are sorted: sent to all tasks, the tables of all counts would meet in the driver
    ordered = groups.join(moved.withColumnRenamed("n", "m").hint("merge"), keys) if moved is not groups else groups.withColumn(
        "m", F.col("n")
    )
    both_ways = ordered.agg(F.coalesce(F.sum((F.col("n") * F.col("m")).cast("decimal(38,0)")), F.lit(0)).alias("p"))
    alone = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("p"))
    signed = both_ways.select(F.col("p").cast("decimal(38,0)")).unionByName(
        alone.select((-F.col("p")).cast("decimal(38,0)").alias("p"))
    )
    return signed.agg((F.sum("p") / 2).cast("decimal(38,0)").alias("pairs"))
