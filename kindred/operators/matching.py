"""Linkage: profiles → blocks → similar pairs → rule → record pairs.

Records that agree in every compared column form one profile and are compared once, however
many copies there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kindred.functions.strings import both_empty_zero, exact, jaro_winkler
from kindred.operators.blocking import Indexer, block_members, placed_members
from kindred.operators.pairjoin import COPIES_IN_ROW, FEW_BLOCKS, TILE_ROWS, Candidates, similar_pairs
from kindred.session import cut_lineage

FEW_STRATEGIES = 6

#: similarity values are rounded so that thresholds do not hang on the last binary digit
DIGITS = 9


def rounded(value: Column) -> Column:
    """``round(value, DIGITS)``; the slow decimal rounding only of values that are about half-way."""
    scaled = value * 10.0**DIGITS
    plain = (F.abs(value) < 1e3) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(plain, F.rint(scaled) / 10.0**DIGITS).otherwise(F.round(value, DIGITS))


@dataclass(frozen=True)
class Rule:
    """A match decision.

    ``measures`` maps a label to (column, "jaro_winkler" | "exact"). ``floors`` names, per
    column, a Jaro-Winkler value every match must exceed; they are what ``condition``
    already implies and let the pair join drop pairs early. So does ``early``, which gets the rounded Jaro-Winkler
    similarities by column, and a function that tells which pairs are equal in a column, as arrays.
    """

    measures: dict[str, tuple[str, str]]
    floors: dict[str, float]
    condition: Callable[[], Column]
    both_empty_is_zero: bool = False
    extra: dict[str, Callable[[], Column]] = field(default_factory=dict)
    early: Callable[[dict[str, np.ndarray], Callable[[str], np.ndarray]], np.ndarray] | None = None


def _all(masks: list[np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce(masks)


def band_or_exact(name: str, *same: str) -> Rule:
    """0.80 < name < 0.92, or name > 0.9 with equal other columns."""
    labels = {f"{c}_exact": (c, "exact") for c in same}
    strong = lambda: reduce(lambda a, b: a & b, [F.col(c) == 1 for c in labels], F.col("name_sim") > 0.9)
    return Rule(
        {"name_sim": (name, "jaro_winkler"), **labels},
        {name: 0.80},
        lambda: ((F.col("name_sim") > 0.80) & (F.col("name_sim") < 0.92)) | strong(),
        early=lambda sim, equal: (sim[name] < 0.92) | _all([equal(c) for c in same]),
    )


def band_or_similar(name: str, *alike: str) -> Rule:
    """0.80 < name < 0.92, or name > 0.9 with the other columns above 0.5."""
    labels = {f"{c}_sim": (c, "jaro_winkler") for c in alike}
    strong = lambda: reduce(lambda a, b: a & b, [F.col(c) > 0.5 for c in labels], F.col("name_sim") > 0.9)
    return Rule(
        {"name_sim": (name, "jaro_winkler"), **labels},
        {name: 0.80},
        lambda: ((F.col("name_sim") > 0.80) & (F.col("name_sim") < 0.92)) | strong(),
        early=lambda sim, equal: (sim[name] < 0.92) | _all([sim[c] > 0.5 for c in alike]),
    )


def mandatory_and_k_of_n(
    cols: list[str], mandatory: dict[str, float], at_least: float = 0.75, k: int = 2
) -> Rule:
    """Mandatory columns above their floors and at least ``k`` columns at ``at_least`` or more."""
    labels = {f"{c}_similarity": (c, "jaro_winkler") for c in cols}

    def condition() -> Column:
        must = reduce(lambda a, b: a & b, [F.col(f"{c}_similarity") > t for c, t in mandatory.items()])
        votes = reduce(lambda a, b: a + b, [(F.col(c) >= at_least).cast("int") for c in labels])
        return must & (votes >= k)

    return Rule(labels, mandatory, condition, both_empty_is_zero=True)


def open_band(cols: list[str], name: str, low: float = 0.7, high: float = 0.9) -> Rule:
    labels = {f"{c}_similarity": (c, "jaro_winkler") for c in cols}
    at = f"{name}_similarity"
    early = lambda sim, equal: sim[name] < high
    return Rule(labels, {name: low}, lambda: (F.col(at) > low) & (F.col(at) < high), both_empty_is_zero=True, early=early)


# fixed values: weights of the weighted score, by role of the column
WEIGHTS = {"name": 0.4, "industry": 0.3, "city": 0.2, "country": 0.05, "ownership": 0.05}


def weighted_score(present: dict[str, str]) -> Column:
    """Weighted sum of the similarities of the roles present; an absent role adds nothing."""
    return rounded(reduce(lambda a, b: a + b, [F.col(label) * WEIGHTS[role] for role, label in present.items()]))


def weighted_with_floor(roles: dict[str, str], score: float = 0.75, name_floor: float = 0.80) -> Rule:
    """``roles`` maps name/industry/city/country/ownership to columns."""
    labels = {role: f"{role}_sim" for role in roles}
    return Rule(
        {labels[role]: (col, "jaro_winkler") for role, col in roles.items()},
        {roles["name"]: name_floor},
        lambda: (F.col("weighted_score") > score) & (F.col("name_sim") > name_floor),
        extra={"weighted_score": lambda: weighted_score(labels)},
        early=lambda sim, equal: sum(sim[col] * WEIGHTS[role] for role, col in roles.items()) > score - 1e-6,
    )


def profiles(df: DataFrame, cols: list[str], row_id: str = "rec_id") -> DataFrame:
    """Distinct value combinations with their smallest record id and number of records."""
    return df.groupBy(*cols).agg(F.min(row_id).alias(row_id), F.count(F.lit(1)).alias("n_records"))


def similarities(pairs: DataFrame, rule: Rule, known: dict[str, str]) -> DataFrame:
    """Add one column per measure; ``known`` maps columns to similarities already there, and rounded."""
    added = {}
    for label, (col, kind) in rule.measures.items():
        left, right = F.col(f"{col}_left"), F.col(f"{col}_right")
        if kind == "exact":
            added[label] = exact(left, right)
            continue
        value = F.col(known[col]) if col in known else F.round(jaro_winkler(left, right), DIGITS)
        added[label] = both_empty_zero(left, right, value) if rule.both_empty_is_zero else value
    return pairs.withColumns(added)


def hydrate(pairs: DataFrame, records: DataFrame, cols: list[str], row_id: str = "rec_id") -> DataFrame:
    """Bring ``cols`` of both records beside the pair, with ``_left`` / ``_right`` suffixes."""
    out = pairs
    for side in ("left", "right"):
        part = records.select(F.col(row_id).alias(f"id_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in cols])
        out = out.join(part, f"id_{side}", "left")
    return out


Counts = dict[str, Observation]


def watched(df: DataFrame, step: str, counts: Counts | None) -> DataFrame:
    """``df``, whose rows are counted under ``step`` as they pass by; no job of its own."""
    if counts is None:
        return df
    counts[step] = Observation(step)
    return df.observe(counts[step], F.count(F.lit(1)).alias("n"))


def with_copies(df: DataFrame, cols: list[str], row_id: str = "rec_id") -> DataFrame:
    """:func:`profiles` with the ids of their records in ``copies``; a profile of many records is several rows."""
    records = df.select(row_id, *cols).filter(F.col(row_id).isNotNull())
    parts = F.ceil(F.col("n_records") / COPIES_IN_ROW).cast("int")
    # a written table, as for the blocks of a pair join: hot profiles are not brought together
    hot = cut_lineage(profiles(records, cols, row_id).filter(F.col("n_records") > COPIES_IN_ROW).select(*[F.col(c).alias(f"_{c}") for c in cols], parts.alias("_parts")))
    found = hot.limit(FEW_BLOCKS + 1).count()
    if found:
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols])
        records = records.join(F.broadcast(hot) if found <= FEW_BLOCKS else hot, same, "left")
        part = F.pmod(F.xxhash64(row_id), F.coalesce("_parts", F.lit(1)))
    else:
        part = F.lit(0)
    grouped = records.groupBy(*cols, part.alias("_part"))
    return grouped.agg(F.min(row_id).alias(row_id), F.count(F.lit(1)).alias("n_records"), F.collect_list(row_id).alias("copies")).drop("_part")


def candidate_pairs(
    shapes: DataFrame,
    cols: list[str],
    indexers: list[Indexer],
    rule: Rule,
    differ: str | None,
    row_id: str,
    tile_rows: int,
    counts: Counts | None = None,
) -> DataFrame:
    """Accepted pairs of ``shapes``, each once, with ``_bits`` of the indexers that pair it; of records if there are ``copies``.

    The pair join knows the compared columns of its rows and all their blocks, so a pair is measured, told from its
    repeats and completed where it is found; pairs, which outgrow the records, are never shuffled.
    """
    if len(indexers) > 62:
        raise ValueError("at most 62 different blockings")
    members, keys, places = placed_members(shapes, indexers)
    measure = [c for c, kind in rule.measures.values() if kind != "exact"]
    copies = "copies" if "copies" in shapes.columns else None
    # steps are counted before the rule, on all pairs above the floors
    early = rule.early if counts is None else None
    kernel = Candidates(rule.floors, differ, "anchor", places, cols, measure, copies, DIGITS, early)
    conf = shapes.sparkSession.conf
    if conf.get("spark.sql.codegen.wholeStage") != "true" or 2 * len(cols) + len(kernel.fields) + 8 > int(conf.get("spark.sql.codegen.maxFields")):
        kernel.rows_out = 64  # without generated code the lists of a row are copied with each of its pairs
    found = similar_pairs(watched(members, "members", counts), kernel, "block", row_id, tile_rows, keys)
    known = {c: f"_{c}" for c in dict.fromkeys([*rule.floors, *measure])}
    found = watched(found.withColumnsRenamed({f"{c}_sim": k for c, k in known.items()}), "similar", counts)
    kinds = dict(shapes.dtypes)
    typed = {f"{c}_{side}": F.col(f"{c}_{side}").cast(kinds[c]) for c in cols for side in ("left", "right") if kinds[c] != "string"}
    return watched(decide(found.withColumns(typed) if typed else found, rule, known), "matches", counts)


def match_profiles(
    df: DataFrame,
    cols: list[str],
    indexers: list[Indexer],
    rule: Rule,
    differ: str | None = None,
    row_id: str = "rec_id",
    tile_rows: int = TILE_ROWS,
    counts: Counts | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Matching profile pairs, and the profiles.

    ``cols`` are the compared and reported columns; ``differ`` leaves out pairs equal there. ``counts`` is filled with
    the rows of every step, to be read when the result has been.
    """
    # read by every indexer and for both sides
    shapes = cut_lineage(watched(profiles(watched(df, "records", counts), cols, row_id), "profiles", counts))
    return candidate_pairs(shapes, cols, indexers, rule, differ, row_id, tile_rows, counts).drop("_bits"), shapes


def linkage_steps(
    df: DataFrame, cols: list[str], indexers: list[Indexer], rule: Rule, name: str, row_id: str = "rec_id"
) -> tuple[DataFrame, DataFrame]:
    """The matching profile pairs, written, and ``step, n``: how many rows every step of the linkage had.

    Records, profiles, members of blocks, pairs above the rule's floors and matches are counted while the linkage
    runs, once.
    """
    counts: Counts = {}
    matches = cut_lineage(match_profiles(df, cols, indexers, rule, name, row_id, counts=counts)[0])
    rows = [(step, int(seen.get["n"])) for step, seen in counts.items()]
    return matches, df.sparkSession.createDataFrame(rows, "step string, n long")


def match_strategies(
    df: DataFrame,
    cols: list[str],
    strategies: dict[str, list[Indexer]],
    rule: Rule,
    differ: str | None = None,
    row_id: str = "rec_id",
    tile_rows: int = TILE_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Matching profile pairs with ``strategies``, the names of those that propose the pair, and the profiles.

    A strategy is a union of blockings, and strategies may share some. Every blocking is looked at once: its members
    carry its bit, a pair gathers the bits of the blocks it is met in, and a strategy proposes the pairs that have a
    bit of one of its blockings. So several linkages cost one.
    """
    shapes = cut_lineage(profiles(df, cols, row_id))
    return _named_strategies(shapes, cols, strategies, rule, differ, row_id, tile_rows), shapes


def _named_strategies(
    shapes: DataFrame, cols: list[str], strategies: dict[str, list[Indexer]], rule: Rule, differ: str | None, row_id: str, tile_rows: int
) -> DataFrame:
    indexers = list(dict.fromkeys(ix for chosen in strategies.values() for ix in chosen))
    pairs = candidate_pairs(shapes, cols, indexers, rule, differ, row_id, tile_rows)
    by = {name: sum(1 << indexers.index(ix) for ix in set(chosen)) for name, chosen in strategies.items()}
    met = [F.col("_bits").bitwiseAND(F.lit(bits).cast("long")) != 0 for bits in by.values()]
    if len(by) > FEW_STRATEGIES:
        named = F.array_compact(F.array(*[F.when(at, F.lit(name)) for at, name in zip(met, by, strict=True)]))
    else:  # a table of all sets of strategies, which unlike the above is part of the generated code
        sets = [[name for k, name in enumerate(by) if at >> k & 1] for at in range(1 << len(by))]
        number = reduce(lambda a, b: a + b, [F.when(at, F.lit(1 << k)).otherwise(F.lit(0)) for k, at in enumerate(met)])
        named = F.get(F.array(*[F.array(*map(F.lit, names)).cast("array<string>") for names in sets]), number)
    return pairs.withColumn("strategies", named).drop("_bits")


def membership(df: DataFrame, shapes: DataFrame, cols: list[str], row_id: str = "rec_id") -> DataFrame:
    """(profile, ``row_id``) of every record: with it, matches of profiles stand for matches of records."""
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols])
    named = shapes.select(F.col(row_id).alias("profile"), *[F.col(c).alias(f"_{c}") for c in cols])
    return df.select(row_id, *cols).join(named, same).select("profile", row_id)


def decide(pairs: DataFrame, rule: Rule, known: dict[str, str]) -> DataFrame:
    """Measure hydrated pairs and keep those the rule accepts."""
    scored = similarities(pairs, rule, known).drop(*known.values())
    if rule.extra:
        scored = scored.withColumns({label: build() for label, build in rule.extra.items()})
    return scored.filter(rule.condition())


def link_records(
    df: DataFrame,
    cols: list[str],
    indexers: list[Indexer],
    rule: Rule,
    name: str,
    row_id: str = "rec_id",
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Matching record pairs with both records side by side; equal names left out."""
    shapes = cut_lineage(with_copies(df, cols, row_id))
    return candidate_pairs(shapes, cols, indexers, rule, name, row_id, tile_rows).drop("_bits")


def link_strategies(
    df: DataFrame, cols: list[str], strategies: dict[str, list[Indexer]], rule: Rule, name: str, row_id: str = "rec_id"
) -> DataFrame:
    """:func:`link_records` for several strategies at once: every record pair with the ``strategies`` that propose it."""
    shapes = cut_lineage(with_copies(df, cols, row_id))
    return _named_strategies(shapes, cols, strategies, rule, name, row_id, TILE_ROWS)


def not_identical(left: Column, right: Column) -> Column:
    """True unless both values are there and equal (a missing value equals nothing)."""
    return ~F.coalesce(left == right, F.lit(False))


def matches_within(shapes: DataFrame, cols: list[str], indexers: list[Indexer], rule: Rule, row_id: str = "rec_id") -> DataFrame:
    """Profiles whose copies the rule accepts as matches of each other, in the form of profile pairs."""
    blocked = block_members(shapes, indexers).select(row_id).distinct()
    both = shapes.filter("n_records > 1").join(blocked, row_id, "left_semi")
    sides = [F.col(c).alias(f"{c}_{side}") for c in [*cols, "n_records"] for side in ("left", "right")]
    return decide(both.select(F.col(row_id).alias("id_left"), F.col(row_id).alias("id_right"), *sides), rule, {})


def export_blocked_pairs(
    df: DataFrame, cols: list[str], indexers: list[Indexer], rule: Rule, name: str, row_id: str = "rec_id"
) -> DataFrame:
    """Matches as unlabelled sentence pairs for a later scorer, identical names among them.

    One row per pair of profiles, named by the smaller one's id, with the number of record pairs it
    stands for; the copies of one profile are a pair of the profile with itself.
    """
    matches, shapes = match_profiles(df, cols, indexers, rule, None, row_id)
    n, m = (F.col(f"n_records_{side}").cast("decimal(19,0)") for side in ("left", "right"))

    def pairs(found: DataFrame, count: Column) -> DataFrame:
        texts = [F.col(f"{name}_left").alias("sentence1"), F.col(f"{name}_right").alias("sentence2")]
        return found.select(F.col("id_left").alias("id"), *texts, F.lit("?").alias("label"), count.cast("decimal(38,0)").alias("n_pairs"))

    within = matches_within(shapes, cols, indexers, rule, row_id)
    return pairs(matches, n * m).unionByName(pairs(within, n * (n - 1) / 2))
