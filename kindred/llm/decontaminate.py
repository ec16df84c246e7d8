"""Benchmark decontamination by SimHash over item-sized windows.

Every benchmark item is a set of five-word shingles. A document is read through a window as long as
the item, in words, at every position where the window holds at least one shingle of an item of that
length (no other window can be similar). A window holds an item if the larger of two similarities is
0.8 or more:

* the Jaccard similarity of the shingle sets;
* the same with weights, so that wording common to many items counts little: a shingle of the item
  weighs one over the number of different item sets that have it, any other as much as the item's
  shingles do on average. Equal item sets are counted once, over the whole benchmark.

The first is found by SimHash: a window's fingerprint is the sign of the sum of its shingles' 256
random signs; sums over windows are differences of running sums. A fingerprint is cut into 64 blocks
of four bits: two fingerprints at most 63 bits apart agree in one block at least, so the items sharing
a block are all items within the radius. All shingles count alike in it: at similarity 0.8 the cosine
is 0.89 or more and the expected distance at most 39 of 256 bits, whatever the weights, and 63 is over
four standard deviations away. The second differs from the first only for items whose shingles differ
in weight; it needs four fifths of the item's weight inside the window, which is summed up exactly.
What either finds is verified by both similarities.

Benchmarks are taken in blocks of ``BLOCK_ITEMS`` items, one pass each, so what a task holds of
them is bounded however many there are; results do not depend on the blocks. Documents are never shuffled.

Defined results: null or empty texts and items match nothing; an item of one to four words is one
shingle, its whole sequence, and is found where exactly these words stand; repeated items are each
found; repeated rows are each reported; further columns are ignored. Of several windows of a
document that match an item the most similar and then first is reported, with their number.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.text import _MULT, SHINGLE_WORDS, batch_words, mix, shingle_hashes
from kindred.session import cut_lineage

BITS, BLOCK_BITS = 256, 4
BLOCKS = BITS // BLOCK_BITS
RADIUS = BLOCKS - 1
SIMILARITY = 0.8
BLOCK_ITEMS = 20_000
_SEEN_BITS = 22
_SLACK = 1e-9  # sums of weights are rounded


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for every bit of every shingle's 256 random bits."""
    lanes = np.stack([mix(hashes + np.uint64((2 * k + 1) * 0x5851F42D4C957F2D & (1 << 64) - 1)) for k in range(BITS // 64)], axis=1)
    return (np.unpackbits(lanes.view(np.uint8), axis=1).astype(np.int8) * 2 - 1).astype(np.int8)


def _nibbles(fingerprints: np.ndarray) -> np.ndarray:
    return np.stack([fingerprints >> 4, fingerprints & 15], axis=2).reshape(len(fingerprints), BLOCKS)


def _fingerprints(hashes: np.ndarray, width: int) -> np.ndarray:
    """SimHash of every run of ``width`` shingles, 32 bytes each."""
    sums = np.zeros((len(hashes) + 1, BITS), dtype=np.int32)
    np.cumsum(_signs(hashes), axis=0, out=sums[1:])
    return np.packbits(sums[width:] - sums[: len(sums) - width] > 0, axis=1)


class Items:
    """A block of benchmark items, by their number of words.

    ``shared`` has the shingles of several item sets of the benchmark, ascending, and ``counts`` of how many.
    """

    def __init__(self, ids: list[int], texts: list[str | None], shared: np.ndarray, counts: np.ndarray) -> None:
        self.words: dict[int, list[int]] = defaultdict(list)  # by length in words: items
        self.ids, self.sets = ids, []
        n = 0
        for _, _, words, first in batch_words(pa.array(texts, pa.string())):
            hashes, at = shingle_hashes(words, first)
            for d in range(len(first) - 1):
                self.sets.append(np.unique(hashes[at[d] : at[d + 1]]))
                if length := int(first[d + 1] - first[d]):
                    self.words[length].append(n)
                n += 1
        self.known = known = np.unique(np.concatenate([*self.sets, np.zeros(0, np.uint64)]))
        self.weights = np.ones(len(known))
        self.weights[np.searchsorted(known, shared)] = 1.0 / counts
        self.seen = np.zeros(1 << _SEEN_BITS, dtype=bool)
        self.seen[known >> np.uint64(64 - _SEEN_BITS)] = True
        # the lengths in words of the items that have a shingle
        self.lengths: list[set[int]] = [set() for _ in known]
        self.index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length, members in self.words.items():
            prints = np.concatenate([_fingerprints(self.sets[m], len(self.sets[m])) for m in members])
            table = np.zeros((BLOCKS, 1 << BLOCK_BITS, -(-len(members) // 8)), dtype=np.uint8)
            nibbles = _nibbles(prints)
            for row, m in enumerate(members):
                table[np.arange(BLOCKS), nibbles[row], row >> 3] |= np.uint8(1 << (row & 7))
                for k in np.searchsorted(known, self.sets[m]):
                    self.lengths[k].add(length)
            self.index[length] = (np.array(members), prints, table)
        # items whose shingles differ in weight, by shingle
        self.totals = np.zeros(n)
        self.length_of = np.zeros(n, dtype=np.int64)
        uneven, places = [], []
        for length, members in self.words.items():
            for m in members:
                at = np.searchsorted(known, self.sets[m])
                self.totals[m], self.length_of[m] = self.weights[at].sum(), length
                if self.weights[at].min() < self.weights[at].max():
                    uneven.append(np.full(len(at), m))
                    places.append(at)
        at = np.concatenate([*places, np.zeros(0, np.int64)])
        self.uneven = np.concatenate([*uneven, np.zeros(0, np.int64)])[np.argsort(at, kind="stable")]
        self.uneven_at = np.searchsorted(np.sort(at), np.arange(len(known) + 1))

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Positions among the known shingles, -1 for others."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.seen[hashes >> np.uint64(64 - _SEEN_BITS)])
        if len(maybe) and len(self.known):
            at = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
            right = self.known[at] == hashes[maybe]
            out[maybe[right]] = at[right]
        return out

    def similarity(self, window: np.ndarray, item: int) -> float:
        own, mine = np.unique(window), self.sets[item]
        both = np.intersect1d(own, mine, assume_unique=True)
        foreign = len(own) - len(both)
        total = self.totals[item]
        weighted = self.weights[np.searchsorted(self.known, both)].sum() / (total + foreign * total / len(mine))
        return float(max(weighted, len(both) / (len(mine) + foreign)))

    def search(self, words: np.ndarray, hashes: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int, float, int, int]]:
        """(item, first word, words, similarity, distance, windows) for one document.

        ``hashes`` are the document's shingles, ``place`` their numbers among the known ones.
        """
        long_hits: dict[int, list[int]] = defaultdict(list)
        for at in np.flatnonzero(place >= 0).tolist():
            for length in self.lengths[place[at]]:
                if length >= SHINGLE_WORDS or len(words) == length:
                    long_hits[length].append(at)
        uneven = self._heavy(place)
        for length, hits in long_hits.items():
            width = max(1, length - SHINGLE_WORDS + 1)
            yield from self._windows(length, width, hashes, np.array(hits), place, uneven[length])

    def _heavy(self, place: np.ndarray) -> dict[int, list[int]]:
        """By length, items of uneven weights of which the document has four fifths of the weight."""
        out: dict[int, list[int]] = defaultdict(list)
        if len(self.uneven):
            here = np.unique(place[place >= 0])
            n = self.uneven_at[here + 1] - self.uneven_at[here]
            items = self.uneven[np.repeat(self.uneven_at[here] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            names, back = np.unique(items, return_inverse=True)
            weight = np.bincount(back, weights=np.repeat(self.weights[here], n), minlength=len(names))
            for m in names[weight >= SIMILARITY * self.totals[names] - _SLACK].tolist():
                out[int(self.length_of[m])].append(m)
        return out

    def _windows(self, length: int, width: int, hashes: np.ndarray, hits: np.ndarray, place: np.ndarray, uneven: list[int]) -> Iterator[tuple]:
        members, prints, table = self.index[length]
        last = len(hashes) - width
        own = min(width, len(hashes))
        found_at: dict[int, set[int]] = defaultdict(set)  # by row of the item: windows to verify
        # runs of windows that hold a hit; a document shorter than the item is one short window
        if last < 0:
            runs = [(0, 0)]
        else:
            lo, hi = np.maximum(hits - width + 1, 0), np.minimum(hits, last)
            runs = []
            for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                if runs and a <= runs[-1][1] + 1:
                    runs[-1][1] = max(runs[-1][1], b)
                elif a <= b:
                    runs.append([a, b])
        for a, b in runs:
            for start in range(a, b + 1, 512):
                stop = min(b + 1, start + 512)
                found = _fingerprints(hashes[start : stop - 1 + own], own)
                shared = np.bitwise_or.reduce(table[np.arange(BLOCKS)[None, :], _nibbles(found)], axis=1)
                near = np.unpackbits(shared, axis=1, bitorder="little")[:, : len(members)]
                for w, row in zip(*np.nonzero(near), strict=True):
                    if int(np.bitwise_count(found[w] ^ prints[row]).sum()) <= RADIUS:
                        found_at[int(row)].add(start + int(w))
        for m in uneven:
            at = np.searchsorted(self.known, self.sets[m])
            mine = np.where(np.isin(place, at), self.weights[place], 0.0)
            sums = np.concatenate([[0.0], np.cumsum(mine)])
            heavy = np.flatnonzero(sums[own:] - sums[: len(sums) - own] >= SIMILARITY * self.totals[m] - _SLACK)
            found_at[int(np.searchsorted(members, m))].update(heavy.tolist())
        for row, windows in found_at.items():
            item, best, n = int(members[row]), (-1.0, 0), 0
            for at in sorted(windows):
                similar = self.similarity(hashes[at : at + own], item)
                if similar >= SIMILARITY - _SLACK:
                    n += 1
                    if similar > best[0]:
                        best = similar, at
            if n:
                similar, at = best
                print_ = _fingerprints(hashes[at : at + own], own)[0]
                yield item, at, length, max(similar, SIMILARITY), int(np.bitwise_count(print_ ^ prints[row]).sum()), n

    def short_items(self, words: np.ndarray) -> Iterator[tuple[int, int, int, float, int, int]]:
        """Items of one to four words inside a longer document."""
        for length, members in self.words.items():
            if length >= SHINGLE_WORDS or len(words) <= length:
                continue
            total = np.zeros(len(words) - length + 1, dtype=np.uint64)
            for j in range(length):
                total += words[j : len(words) - length + 1 + j] * _MULT[j]
            grams = mix(total + np.uint64(length))
            for m in members:
                at = np.flatnonzero(grams == self.sets[m][0])
                if len(at):
                    yield m, int(at[0]), length, 1.0, 0, len(at)


HITS = "doc_id long, item_id long, first_word long, n_words long, similarity double, distance int, n_windows long"


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of every item, ascending, beside its block."""
    for batch in batches:
        for lo, hi, words, first in batch_words(batch.column(1)):
            hashes, at = shingle_hashes(words, first)
            sets = [np.unique(hashes[at[d] : at[d + 1]]).view(np.int64) for d in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.list_(pa.int64()))], ["block", "shingles"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per document (doc_id, text) and benchmark item (item_id, text) found in it."""
    spark = docs.sparkSession
    blocks = -(-benchmark.count() // block_items)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    result = spark.createDataFrame([], HITS)
    if not blocks:
        return result
    dealt = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"),
        F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int").alias("block"),
    )
    sets = cut_lineage(dealt.select("block", "text").mapInArrow(_item_shingles, "block int, shingles array<long>"))
    of_several = sets.select("shingles").distinct().select(F.explode("shingles").alias("shingle")).groupBy("shingle").count().where("count > 1")
    of_several = cut_lineage(of_several)
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).collect()  # block_items at most, but for chance
        if not rows:
            continue
        here = sets.where(F.col("block") == block).select(F.explode("shingles").alias("shingle")).distinct()
        shared = here.join(of_several, "shingle").toPandas()
        hashes, counts = shared["shingle"].to_numpy().astype(np.int64).view(np.uint64), shared["count"].to_numpy().astype(np.int64)
        order = np.argsort(hashes)
        items = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], hashes[order], counts[order]))

        def search(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            known = items.value
            short = any(n < SHINGLE_WORDS for n in known.words)
            for batch in batches:
                ids, out = batch.column(0), []
                for lo, hi, words, first in batch_words(batch.column(1)):
                    hashes, at = shingle_hashes(words, first)
                    place = known.place(hashes)
                    hit = np.add.reduceat(np.append(place >= 0, False), at[:-1], dtype=np.int64) * (np.diff(at) > 0)
                    for d in range(hi - lo) if short else np.flatnonzero(hit).tolist():
                        own, span = words[first[d] : first[d + 1]], slice(at[d], at[d + 1])
                        found = list(known.search(own, hashes[span], place[span])) if hit[d] else []
                        if short:
                            found += known.short_items(own)
                        out += [(ids[lo + d].as_py(), known.ids[m], *rest) for m, *rest in found]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], NAMES
                    )

        result = result.unionByName(source.mapInArrow(search, HITS))
    return result


NAMES = [c.split()[0] for c in HITS.split(", ")]
TYPES = [{"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}[c.split()[1]] for c in HITS.split(", ")]
