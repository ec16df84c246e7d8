"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source that shall give ``f`` times its size is copied ``floor(f)`` times, and once
more with the fractional rest as probability. The rests are rounded dependently: two documents
with fractional probabilities exchange mass, counted in words, until one of them is 0 or 1; the
direction is drawn so that every expectation stays. The words of a pair do not change, hence a
whole source misses its target by less than one document.

Documents of a source are dealt by the hash of their id into blocks of bounded size. Each block
rounds all but one of its documents; the ones left over meet in a reduction tree of fan-in 64 until
one document per source remains, which is drawn by itself. Random numbers depend on the seed, the
source's rank, block and level, and documents are taken in the order of a hash of their id, so
reruns agree however the data are partitioned.

Defined results: a null text has size 0; a document of size 0 takes no words and is copied once if
its source is wanted at all; a null source is a source, last in order; repeated rows are rounded
one by one, many rows of one id or without one in blocks dealt by row; ties of the hash are taken by id and size; a text of
any length counts whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.session import cut_lineage

BLOCK_DOCS = 4096
FAN_IN = 64
CEILING = 3


def word_count(text):
    """Number of maximal runs of characters other than space, tab, line and page breaks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), ceiling: int = CEILING) -> DataFrame:
    """Per source of ``sizes`` (source, size): ``rank``, ``source_size``, ``n_docs`` and ``target``.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all
    sizes. No target exceeds ``ceiling`` times its source: whoever reaches its limit at the lowest
    level of the rest is settled first, the others share what remains by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    base = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("rank", F.row_number().over(by_name))
        .withColumn("w", w)
        .withColumn("limit", F.col("source_size") * float(ceiling))
        .withColumn("ratio", F.col("limit") / F.col("w"))
    )
    order = Window.orderBy("ratio", "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after)
    met = base.withColumn("level", level).withColumn("open", F.col("level") <= F.col("ratio"))
    # levels fall from the first source that stays below its limit on: theirs is the common level
    common = F.min(F.when(F.col("open"), F.struct("ratio", "rank", "level"))).over(everything)["level"]
    return met.withColumn("common", common).select(
        "source", "rank", "source_size", "n_docs",
        F.when(F.col("common").isNull() | (F.col("ratio") <= F.col("common")), F.col("limit")).otherwise(F.col("w") * F.col("common")).alias("target"),
    )


def pivotal(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Round ``p`` so that sum(p * size) stays; the index of the one element left fractional, or -1."""
    p, size, u = p.tolist(), size.tolist(), u.tolist()
    left = -1
    for j, q in enumerate(p):
        if q <= 0.0 or q >= 1.0:
            continue
        if left < 0:
            left = j
            continue
        i, a, b = left, p[left], q
        si, sj = size[i], size[j]
        up, down = min((1 - a) * si, b * sj), min(a * si, (1 - b) * sj)
        if u[j] * (up + down) < down:  # i gains what j gives
            full = (1 - a) * si <= b * sj
            p[i], p[j] = (1.0, max(0.0, b - up / sj)) if full else (min(1.0, a + up / si), 0.0)
        else:
            empty = a * si <= (1 - b) * sj
            p[i], p[j] = (0.0, min(1.0, b + down / sj)) if empty else (max(0.0, a - down / si), 1.0)
        left = next((k for k in (i, j) if 0.0 < p[k] < 1.0), -1)
    return np.asarray(p), left


def _round_blocks(rows: DataFrame, level: int, seed: int, last: bool) -> DataFrame:
    """Round each (rank, block); ``p`` of what is left over stays fractional unless ``last``."""

    def rounded(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id", "size"], kind="stable", ignore_index=True)
        u = np.random.default_rng([seed, level, int(key[0]), int(key[1])]).random(len(pdf) + 1)
        p, left = pivotal(pdf["p"].to_numpy(), pdf["size"].to_numpy().astype(float), u[:-1])
        if last and left >= 0:
            p[left] = float(u[-1] < p[left])
        return pdf.assign(p=p)

    return rows.groupBy("rank", "block").applyInPandas(rounded, rows.schema)


def _dealt(narrow: DataFrame) -> DataFrame:
    """``narrow`` with a hash of the row for ids, or none, that very many rows have: they do not share a block."""
    often = cut_lineage(narrow.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FAN_IN).select(F.col("h").alias("_often")))
    if often.isEmpty():
        return narrow
    met = narrow.join(often, F.col("h") == F.col("_often"), "left")
    return met.withColumn("h", F.when(F.col("_often").isNotNull(), F.xxhash64("h", "row")).otherwise(F.col("h"))).drop("_often")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    ceiling: int = CEILING,
    seed: int = 7,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, copies and taken."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row"))
    narrow = _dealt(cut_lineage(sized.withColumn("h", F.xxhash64("doc_id", F.lit(seed)))))
    targets = cut_lineage(source_targets(narrow, weights, ceiling))
    joined = narrow.join(targets, narrow["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    f = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(ceiling)))).otherwise(0.0)
    state = joined.withColumn("f", f).select(
        "doc_id", "size", "h", "rank", "source_size", "target",
        F.when(F.col("size") == 0, (F.col("f") > 0).cast("long")).otherwise(F.floor("f")).alias("base"),
        F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.col("f") - F.floor("f")).alias("p"),
        F.pmod("h", F.ceil(F.col("n_docs") / BLOCK_DOCS)).alias("block"),
    )
    blocks = targets.agg(F.max(F.ceil(F.col("n_docs") / BLOCK_DOCS))).first()[0] or 1
    level, parts, open_ones = 0, [], state
    while True:
        done = cut_lineage(_round_blocks(open_ones, level, seed, blocks <= 1))
        parts.append(done.where("p <= 0 or p >= 1"))
        if blocks <= 1:
            break
        open_ones = done.where("p > 0 and p < 1").withColumn("block", F.expr(f"block div {FAN_IN}"))
        blocks, level = -(-blocks // FAN_IN), level + 1
    rounded = parts[0]
    for part in parts[1:]:
        rounded = rounded.unionByName(part)
    copies = F.col("base") + F.round("p").cast("long")
    return rounded.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
