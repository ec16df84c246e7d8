"""Pairs inside blocks, found without ever shuffling or emitting all pairs of a block.

Rows carry a block. A block with more rows than ``tile_rows`` is cut into tiles by hash, and
every two tiles of it form a unit of their own, so one block that holds a third of the rows is
spread over many tasks. Tasks read their units as a stream of sorted rows; small units are
handled many at a time. Inside a unit a kernel looks at index pairs in steps of bounded size
and returns only the pairs that pass its test. The result is exact for blocks of every size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.strings import Encoded, round_half_up
from kindred.session import cut_lineage

TILE_ROWS = 2048
FEW_BLOCKS = 10_000  # as many hot blocks may be broadcast
_STEP_PAIRS = 1_000_000
_ROWS_OUT = 50_000
COPIES_IN_ROW = 256  # record ids a row holds at most, about


class Kernel:
    """Test applied to pairs of rows of one stretch of units."""

    #: columns the kernel adds to the two ids
    fields: list[T.StructField] = []

    def prepare(self, rows: pd.DataFrame, ids: np.ndarray) -> object:
        raise NotImplementedError

    def schema(self, id_type: T.DataType) -> T.StructType:
        """Of the rows that tasks send."""
        return T.StructType([T.StructField("id_left", id_type), T.StructField("id_right", id_type), *self.fields])

    def unpacked(self, sent: DataFrame) -> DataFrame:
        """A row per pair, of the rows that tasks send."""
        return sent

    def candidates(
        self, ready: object, begin: np.ndarray, count: np.ndarray
    ) -> Iterator[tuple[np.ndarray, ...]]:
        """Index pairs to look at: row ``r`` with the ``count[r]`` rows from ``begin[r]`` on, and what ``keep`` is told of them."""
        yield from _index_pairs(begin, count)

    def keep(self, ready: object, i: np.ndarray, j: np.ndarray, *known: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Positions (into ``i``/``j``) of the pairs to emit and their column values."""
        raise NotImplementedError

    def emit(self, ready: object, ids: np.ndarray, i: np.ndarray, j: np.ndarray, values: dict) -> Iterator[dict]:
        """Columns of the rows that stand for the kept pairs, some ``_ROWS_OUT`` rows at a time."""
        for at in range(0, len(i), _ROWS_OUT):
            part = slice(at, at + _ROWS_OUT)
            yield {"id_left": ids[i[part]], "id_right": ids[j[part]], **{c: v[part] for c, v in values.items()}}


def tile(df: DataFrame, block: str, row_id: str, tile_rows: int = TILE_ROWS, keys: DataFrame | None = None) -> DataFrame:
    """Give every row the units it takes part in: ``_ti``, ``_tj`` and its ``_side``.

    ``keys`` has the ``block`` of every row of ``df`` and is cheap to read; without it the rows are written
    first, as they are read twice: for the sizes of their blocks and for the pairs.
    """
    present = df.filter(F.col(block).isNotNull())
    if keys is None:
        present = keys = cut_lineage(present)
    sizes = keys.groupBy(F.col(block).alias("_large")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > tile_rows)
    parts = F.ceil(F.col("_n") / _rows_per_tile(F.col("_n"), tile_rows)).cast("int")
    # a written table: the rows of a hot block are not brought together to learn its size
    large = cut_lineage(sizes.select("_large", parts.alias("_tiles")))
    found = large.limit(FEW_BLOCKS + 1).count()
    if not found:
        return present.withColumns({c: F.lit(0) for c in ("_ti", "_tj", "_side")})
    known = F.broadcast(large) if found <= FEW_BLOCKS else large
    spread = present.join(known, F.col(block) == F.col("_large"), "left").drop("_large")
    tiles = F.coalesce(F.col("_tiles"), F.lit(1))
    own = F.pmod(F.xxhash64(row_id), tiles).cast("int")
    return (
        spread.withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .withColumn("_ti", F.least("_own", "_other"))
        .withColumn("_tj", F.greatest("_own", "_other"))
        .withColumn("_side", (F.col("_own") > F.col("_other")).cast("int"))
        .drop("_own", "_other", "_tiles")
    )


def _rows_per_tile(n: Column, tile_rows: int) -> Column:
    """Tiles grow with the square root of the block, up to eight times: every row is sent once
    per tile of its block, so larger tiles keep the shuffle of a very large block down."""
    grown = F.sqrt(n * (tile_rows / 32))
    return F.least(F.greatest(grown, F.lit(float(tile_rows))), F.lit(8.0 * tile_rows))


def stage_tasks(df: DataFrame) -> int:
    """Tasks of a pair stage: units differ in work, not in bytes, so it is cut finer than a shuffle."""
    return 3 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _units(frames: Iterator[pd.DataFrame], block: str) -> Iterator[pd.DataFrame]:
    """Re-cut a sorted stream so that no unit is split; waits for at most one unit."""
    waiting: pd.DataFrame | None = None
    for frame in frames:
        if not len(frame):
            continue
        if waiting is not None:
            frame = pd.concat([waiting, frame], ignore_index=True)
        last = frame.iloc[-1]
        open_unit = (
            (frame[block] == last[block]) & (frame["_ti"] == last["_ti"]) & (frame["_tj"] == last["_tj"])
        )
        if not open_unit.all():
            yield frame[~open_unit].reset_index(drop=True)
        waiting = frame[open_unit]
    if waiting is not None:
        yield waiting.reset_index(drop=True)


def _partner_ranges(rows: pd.DataFrame, block: str) -> tuple[np.ndarray, np.ndarray]:
    """For every row the start and number of the rows it is paired with (always one range)."""
    n = len(rows)
    codes, _ = pd.factorize(rows[block])
    ti, tj, side = (rows[c].to_numpy() for c in ("_ti", "_tj", "_side"))
    new = np.ones(n, dtype=bool)
    new[1:] = (codes[1:] != codes[:-1]) | (ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1])
    unit = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    second = np.bincount(unit, weights=side, minlength=len(start)).astype(np.int64)
    at = np.arange(n)
    end = (start + size)[unit]
    inner = ti == tj
    begin = np.where(inner, at + 1, end - second[unit])
    count = np.where(inner, end - at - 1, np.where(side == 0, second[unit], 0))
    return begin, count


def _index_pairs(begin: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs in steps of about ``_STEP_PAIRS``."""
    total = np.cumsum(count)
    row = 0
    while row < len(count):
        done = total[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(total, done + _STEP_PAIRS, side="right")))
        part = count[row:stop]
        size = int(part.sum())
        if size:
            i = np.repeat(np.arange(row, stop), part)
            offset = np.arange(size) - np.repeat(np.cumsum(part) - part, part)
            yield i, np.repeat(begin[row:stop], part) + offset
        row = stop


def similar_pairs(
    df: DataFrame,
    kernel: Kernel,
    block: str = "block",
    row_id: str = "rec_id",
    tile_rows: int = TILE_ROWS,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Pairs of rows of one block that pass ``kernel``, each with ``id_left < id_right``.

    A pair that shares several blocks comes once per block unless the kernel knows better; callers remove
    repeats. ``keys``: see :func:`tile`.
    """
    return _paired(tile(df.filter(F.col(row_id).isNotNull()), block, row_id, tile_rows, keys), kernel, block, row_id)


def pairs_between(
    df: DataFrame, kernel: Kernel, second: str, keys: DataFrame, block: str = "block", row_id: str = "rec_id", tile_rows: int = TILE_ROWS
) -> DataFrame:
    """:func:`similar_pairs` of a row with ``second`` = 0 and one with ``second`` = 1 alone; only such pairs are looked at.

    ``keys`` has ``block`` and ``second`` of every row. A hot block is cut into tiles on both sides, and rows of blocks
    that one side does not have are not sent.
    """
    side = F.col(second)
    parts = lambda n: F.ceil(n / tile_rows).cast("int")
    sizes = cut_lineage(keys.groupBy(F.col(block).alias("_met")).agg(parts(F.sum(1 - side)).alias("_n0"), parts(F.sum(side)).alias("_n1")))
    spread = df.filter(F.col(row_id).isNotNull()).join(sizes.filter("_n0 > 0 AND _n1 > 0"), F.col(block) == F.col("_met"))
    first = side == 0
    own = F.pmod(F.xxhash64(row_id), F.when(first, F.col("_n0")).otherwise(F.col("_n1"))).cast("int")
    units = (
        spread.withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.when(first, F.col("_n1")).otherwise(F.col("_n0")) - 1)))
        .withColumn("_ti", F.when(first, F.col("_own")).otherwise(F.col("_other")))
        .withColumn("_tj", -1 - F.when(first, F.col("_other")).otherwise(F.col("_own")))  # never equal to _ti
        .withColumn("_side", side.cast("int"))
        .drop("_met", "_n0", "_n1", "_own", "_other")
    )
    return _paired(units, kernel, block, row_id)


def _paired(units: DataFrame, kernel: Kernel, block: str, row_id: str) -> DataFrame:
    """The pairs of tiled rows that pass ``kernel``."""
    schema = kernel.schema(units.schema[row_id].dataType)
    names = schema.names
    units = units.repartition(stage_tasks(units), block, "_ti", "_tj").sortWithinPartitions(block, "_ti", "_tj", "_side", row_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _units((batch.to_pandas() for batch in batches), block):
            ids = rows[row_id].to_numpy()
            begin, count = _partner_ranges(rows, block)
            if not count.any():
                continue
            ready = kernel.prepare(rows, ids)
            for i, j, *known in kernel.candidates(ready, begin, count):
                swap = ids[i] > ids[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                kept, values = kernel.keep(ready, i, j, *known)
                for out in kernel.emit(ready, ids, i[kept], j[kept], values):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in map(out.get, names)], names)

    return kernel.unpacked(units.mapInArrow(run, schema))


@dataclass
class NameFloors(Kernel):
    """Pairs whose Jaro-Winkler similarity is above a floor in every named column.

    ``differ`` leaves out pairs equal in that column. ``anchor`` names a flag of which at
    least one row of a pair must have it (used for neighbourhoods). Missing values never pass.
    """

    floors: dict[str, float]
    differ: str | None = None
    anchor: str | None = None
    fields: list[T.StructField] = field(init=False)
    _SMALL = 20_000

    def __post_init__(self) -> None:
        self.fields = [T.StructField(f"{c}_sim", T.DoubleType()) for c in self.floors]

    def prepare(self, rows: pd.DataFrame, ids: np.ndarray) -> object:
        coded = {c: self.coded(rows[c]) for c in {*self.floors, *([self.differ] if self.differ else [])}}
        return coded, rows[self.anchor].to_numpy(dtype=bool) if self.anchor else None

    @staticmethod
    def coded(column: pd.Series) -> tuple[np.ndarray, Encoded]:
        codes, texts = pd.factorize(column)
        return codes, Encoded([str(t) for t in texts])

    def candidates(self, ready: object, begin: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Units of few pairs are looked at pair by pair. In others the distinct values of the first column with a floor are
        held against each other, and only rows whose values are above it are paired, with their similarity."""
        active = np.flatnonzero(count)
        few, end = count.copy(), begin + count
        if not len(active) or not self.floors:
            yield from _index_pairs(begin, count)
            return
        first = np.append(0, np.flatnonzero(np.diff(end[active])) + 1)
        for at, total in zip(first, np.add.reduceat(count[active], first), strict=True):
            if total <= self._SMALL:
                continue
            top = active[at]
            last, second = end[top], begin[top]
            inner = second == top + 1 and count[last - 2] == 1
            few[top : last if inner else second] = 0
            left = np.arange(top, last if inner else second)
            yield from self._by_value(ready, left, left if inner else np.arange(second, last), inner)
        yield from _index_pairs(begin, few)

    def _by_value(self, ready: object, left: np.ndarray, right: np.ndarray, inner: bool) -> Iterator[tuple[np.ndarray, ...]]:
        c, floor = next(iter(self.floors.items()))
        codes, texts = ready[0][c]
        values, start, size, order = self._grouped(codes, left)
        others, begin, number, partner = (values, start, size, order) if inner else self._grouped(codes, right)
        for p, q in texts.likely(values, others, floor, inner):
            if self.differ == c:
                apart = values[p] != others[q]
                p, q = p[apart], q[apart]
            score = texts.jaro_winkler(values[p], others[q])
            good = score > floor - 1e-9
            p, q, score = p[good], q[good], score[good]
            total = np.cumsum(size[p] * number[q])
            at = 0
            while at < len(p):
                stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _STEP_PAIRS, side="right")))
                a, b, known = p[at:stop], q[at:stop], score[at:stop]
                # every row of the left value with the rows of the right one
                pair = np.repeat(np.arange(len(a)), size[a])
                place = start[a][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(size[a]) - size[a], size[a])
                from_, n = begin[b][pair], number[b][pair]
                if inner:  # the rows of one value among themselves
                    same = (a == b)[pair]
                    from_, n = np.where(same, place + 1, from_), np.where(same, from_ + n - place - 1, n)
                for k, with_ in _index_pairs(from_, n):
                    i, j = order[place[k]], partner[with_]
                    yield np.minimum(i, j), np.maximum(i, j), known[pair[k]]
                at = stop

    @staticmethod
    def _grouped(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The codes of some rows without the missing one, where each begins in the rows in order of their code, its number, and these rows."""
        order = rows[np.argsort(codes[rows], kind="stable")]
        values, start, size = np.unique(codes[order], return_index=True, return_counts=True)
        there = values >= 0
        return values[there], start[there], size[there], order

    def hopeful(self, ready: object, i: np.ndarray, j: np.ndarray, scored: bool = False) -> np.ndarray:
        """Positions of the pairs whose bounds are above the floors, the first floor apart if they are ``scored``."""
        coded, flags = ready[:2]
        kept = np.arange(len(i))
        if flags is not None and not flags.all():
            kept = kept[flags[i] | flags[j]]
        if self.differ:
            codes = coded[self.differ][0]
            kept = kept[codes[i[kept]] != codes[j[kept]]]
        for c, floor in list(self.floors.items())[scored:]:
            codes, texts = coded[c]
            a, b = codes[i[kept]], codes[j[kept]]
            full = (a >= 0) & (b >= 0)
            if not full.all():
                kept, a, b = kept[full], a[full], b[full]
            kept = kept[texts.jaro_winkler_above(a, b, floor)]
        return kept

    def keep(self, ready: object, i: np.ndarray, j: np.ndarray, score: np.ndarray | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        return self.measured(ready, i, j, self.hopeful(ready, i, j, score is not None), score, {})

    def measured(
        self, ready: object, i: np.ndarray, j: np.ndarray, kept: np.ndarray, score: np.ndarray | None, values: dict[str, np.ndarray]
    ) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        for at, (c, floor) in enumerate(self.floors.items()):
            if score is not None and not at:
                values[f"{c}_sim"] = score[kept]
                continue
            codes, texts = ready[0][c]
            value = texts.similarity(codes[i[kept]], codes[j[kept]])
            passed = np.flatnonzero(value > floor - 1e-9)
            kept = kept[passed]
            values = {k: v[passed] for k, v in values.items()}
            values[f"{c}_sim"] = value[passed]
        return kept, values


@dataclass
class Candidates(NameFloors):
    """:class:`NameFloors` over rows that know all their blocks: a pair comes once, with everything reported of it.

    ``places`` names per blocking the column that tells where a row stands in it (see ``Indexer.placed``), with the reach
    of a neighbourhood; ``_of`` is the number of the blocking a block belongs to. A pair is emitted in the first block
    that pairs it, so repeats need no shuffle, and ``_bits`` has a bit for every blocking that pairs it. ``cols`` come
    with both sides, ``measure`` names further columns whose similarity (0 if one is missing) is wanted. With ``copies``,
    a column of record ids, every pair of records of the two rows is a row; otherwise ``n_records`` of both sides come.
    ``early`` tells from the similarities per column, and from which pairs are equal in a column, what a rule can accept.
    About ``rows_out`` pairs travel in a row.
    """

    places: dict[str, int | None] = field(default_factory=dict)
    cols: list[str] = field(default_factory=list)
    measure: list[str] = field(default_factory=list)
    copies: str | None = None
    digits: int = 9
    early: Callable[[dict[str, np.ndarray], Callable[[str], np.ndarray]], np.ndarray] | None = None
    rows_out: int = _ROWS_OUT
    _COMMON = 1024

    def __post_init__(self) -> None:
        super().__post_init__()
        self.more = [c for c in self.measure if c not in self.floors]
        self.fields += [T.StructField(f"{c}_sim", T.DoubleType()) for c in self.more]
        self.fields.append(T.StructField("_bits", T.LongType()))

    def schema(self, id_type: T.DataType) -> T.StructType:
        """A row holds many pairs: per pair of records the ids and the numbers of both rows, per pair of rows what is known
        of it, and per row its columns, once."""
        many = {"id_left": id_type, "id_right": id_type, "_left": T.IntegerType(), "_right": T.IntegerType()}
        many |= {"_pair": T.IntegerType()} if self.copies else {}
        many |= {f.name: f.dataType for f in self.fields} | {f"_c{k}": T.StringType() for k in range(len(self.cols))}
        many |= {} if self.copies else {"n_records": T.LongType()}
        return T.StructType([T.StructField(c, T.ArrayType(kind)) for c, kind in many.items()])

    def unpacked(self, sent: DataFrame) -> DataFrame:
        rows = sent.select(*sent.columns, F.posexplode("id_left").alias("_at", "_id"))
        pair = F.get("_pair", F.col("_at")) if self.copies else F.col("_at")
        row = {side: F.get(f"_{side}", F.col("_at")) for side in ("left", "right")}
        known = [F.get(f.name, pair).alias(f.name) for f in self.fields]
        held = {c: f"_c{k}" for k, c in enumerate(self.cols)} | ({} if self.copies else {"n_records": "n_records"})
        sides = [F.get(at, row[side]).alias(f"{c}_{side}") for c, at in held.items() for side in row]
        # neither filters nor projections pass this filter, which holds for all rows: what is above could otherwise be put in
        # place of the columns below, and lists, not their entries, be in every row
        number = F.monotonically_increasing_id().alias("_number")
        pairs = rows.select(F.col("_id").alias("id_left"), F.get("id_right", F.col("_at")).alias("id_right"), *known, *sides, number)
        return pairs.filter("_number >= 0").drop("_number")

    def prepare(self, rows: pd.DataFrame, ids: np.ndarray) -> object:
        coded, flags = super().prepare(rows, ids)
        coded |= {c: self.coded(rows[c]) for c in self.more if c not in coded}
        of = rows["_of"].to_numpy()
        places = []
        for k, (c, reach) in enumerate(self.places.items()):
            held = rows[c]
            if reach is not None:
                places.append((reach, held.fillna(-(2**40)).to_numpy(dtype=np.int64)))
            elif held.map(lambda x: isinstance(x, np.ndarray)).any():
                places.append((None, self._lists(held, rows["block"], of == k)))
            else:
                places.append((None, pd.factorize(held)[0]))
        tables = []
        for c in self.cols:
            codes, texts = pd.factorize(rows[c])
            # the last one stands for a missing value, whose code is -1
            tables.append((np.where(codes < 0, len(texts), codes), pa.array([*texts, None], pa.string())))
        lists = rows[self.copies].to_numpy() if self.copies else rows["n_records"].to_numpy()
        return coded, flags, places, of, tables, lists

    def _lists(self, held: pd.Series, block: pd.Series, here: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Which of its blocks every row may share with another one: all blocks, or those before the row's own one where that
        is of the same blocking (``here``). The ``_COMMON`` commonest are bits of arrays of numbers, others numbers in a matrix."""
        parts = [x if isinstance(x, np.ndarray) else np.empty(0, dtype=object) for x in held]
        sizes = np.array([len(x) for x in parts])
        codes = pd.factorize(np.concatenate([*parts, block.to_numpy(dtype=object)]), sort=True)[0]
        own, flat = codes[sizes.sum() :], codes[: sizes.sum()]
        row = np.repeat(np.arange(len(parts)), sizes)
        wanted = ~here[row] | (flat < own[row])
        row, flat = row[wanted], flat[wanted]
        # a block of one row is shared with none; common blocks first, as most pairs are told by them
        often = np.bincount(flat, minlength=1)
        number = np.empty(len(often), dtype=np.int64)
        number[np.argsort(-often, kind="stable")] = np.arange(len(often))
        shared = often[flat] > 1
        row, flat = row[shared], number[flat[shared]]
        rare = flat >= self._COMMON
        count = np.bincount(row[rare], minlength=len(parts))
        others = np.full((len(parts), int(count.max(initial=0))), -1)
        others[row[rare], np.arange(rare.sum()) - np.repeat(np.cumsum(count) - count, count)] = flat[rare]
        row, flat = row[~rare], flat[~rare]
        words = np.zeros((int(flat.max(initial=-1)) // 64 + 1, len(parts)), dtype=np.uint64)
        np.bitwise_or.at(words, (flat // 64, row), np.uint64(1) << (flat % 64).astype(np.uint64))
        return list(words), others

    def _once(self, ready: object, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs are in the first block that pairs them, and the bits of all blockings that do."""
        places, of = ready[2], ready[3]
        if len(places) == 1 and not isinstance(places[0][1], tuple):
            return np.ones(len(i), dtype=bool), np.ones(len(i), dtype=np.int64)
        of = of[i]
        first, bits = np.ones(len(i), dtype=bool), np.zeros(len(i), dtype=np.int64)
        for k, (reach, held) in enumerate(places):
            if reach is not None:
                a = held[i]
                paired = np.abs(a - held[j]) <= reach
                paired &= a >= 0
            elif isinstance(held, tuple):
                paired, open_ = np.zeros(len(i), dtype=bool), np.arange(len(i))
                words, others = held
                for word in words:
                    met = (word[i[open_]] & word[j[open_]]) != 0
                    paired[open_[met]] = True
                    open_ = open_[~met]
                for c in range(others.shape[1]):
                    a = others[i[open_], c]
                    met = ((others[j[open_]] == a[:, None]) & (a >= 0)[:, None]).any(axis=1)
                    paired[open_[met]] = True
                    open_ = open_[~met]
                here = of == k
                first &= ~(paired & here)
                paired |= here
            else:
                a = held[i]
                paired = (a == held[j]) & (a >= 0)
            first &= ~(paired & (of > k))
            bits |= paired.astype(np.int64) << k
        return first, bits

    def keep(self, ready: object, i: np.ndarray, j: np.ndarray, score: np.ndarray | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        kept = self.hopeful(ready, i, j, score is not None)
        first, bits = self._once(ready, i[kept], j[kept])
        kept, values = self.measured(ready, i, j, kept[first], score, {"_bits": bits[first]})
        for c in self.more:
            codes, texts = ready[0][c]
            a, b = codes[i[kept]], codes[j[kept]]
            full = np.flatnonzero((a >= 0) & (b >= 0))
            values[f"{c}_sim"] = np.zeros(len(kept))
            values[f"{c}_sim"][full] = texts.similarity(a[full], b[full])
        values = {c: v if c == "_bits" else round_half_up(v, self.digits) for c, v in values.items()}
        if self.early is None:
            return kept, values

        def same(c: str) -> np.ndarray:
            codes, texts = ready[4][self.cols.index(c)]
            a = codes[i[kept]]
            return (a == codes[j[kept]]) & (a < len(texts) - 1)

        passed = np.flatnonzero(self.early({c: values[f"{c}_sim"] for c in dict.fromkeys([*self.floors, *self.more])}, same))
        return kept[passed], {c: v[passed] for c, v in values.items()}

    def emit(self, ready: object, ids: np.ndarray, i: np.ndarray, j: np.ndarray, values: dict) -> Iterator[dict]:
        tables, lists = ready[4:]
        size = np.array([len(x) for x in lists]) if self.copies else None
        total = np.cumsum(size[i] * size[j]) if self.copies else np.arange(1, len(i) + 1)
        start = 0
        while start < len(i):
            done = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, done + self.rows_out, side="right")))
            left, right = i[start:stop], j[start:stop]
            held = {c: v[start:stop] for c, v in values.items()}
            used = np.zeros(len(ids), dtype=bool)
            used[left] = used[right] = True
            number, rows = (np.cumsum(used) - 1).astype(np.int32), np.flatnonzero(used)
            if self.copies:
                pair, a, b = self._records(lists, size, left, right)
                some = a != b
                if not some.all():
                    pair, a, b = pair[some], a[some], b[some]
                ordered = a < b
                held |= {"id_left": np.where(ordered, a, b), "id_right": np.where(ordered, b, a), "_pair": pair.astype(np.int32)}
                left, right = number[left][pair], number[right][pair]
                held |= {"_left": np.where(ordered, left, right), "_right": np.where(ordered, right, left)}
            else:
                held |= {"id_left": ids[left], "id_right": ids[right], "_left": number[left], "_right": number[right], "n_records": lists[rows]}
            held |= {f"_c{k}": texts.take(pa.array(codes[rows])) for k, (codes, texts) in enumerate(tables)}
            yield {c: self._one_list(v) for c, v in held.items()}
            start = stop

    @staticmethod
    def _one_list(values: np.ndarray | pa.Array) -> pa.Array:
        array = values if isinstance(values, pa.Array) else pa.array(values)
        return pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)

    @staticmethod
    def _records(lists: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of records of pairs of rows: which pair, and both ids."""
        used = np.zeros(len(lists), dtype=bool)
        used[i] = used[j] = True
        flat = np.concatenate(lists[used])
        begin = np.zeros(len(lists), dtype=np.int64)
        begin[used] = np.cumsum(size[used]) - size[used]
        n = size[i] * size[j]
        pair = np.repeat(np.arange(len(i)), n)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        wide = size[j][pair]
        return pair, flat[begin[i][pair] + place // wide], flat[begin[j][pair] + place % wide]


class Products(Kernel):
    """Base of kernels on unit vectors: a product of single-precision blocks finds the candidates.

    Its error is far below the margin, and ``keep`` decides on exact products.
    """

    threshold: float
    _MARGIN = 1e-4
    _SMALL = 2_000
    _STEP_CELLS = 2_000_000

    def floor(self) -> float:
        return self.threshold

    def candidates(
        self, ready: object, begin: np.ndarray, count: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        end = begin + count
        active = np.flatnonzero(count)
        few = np.zeros(len(count), dtype=bool)
        height = max(1, min(2048, self._STEP_CELLS // max(self.width(ready), 1)))
        # rows with the same last partner lie side by side and form one rectangle (or triangle)
        for rows in np.split(active, np.flatnonzero(np.diff(end[active])) + 1):
            if not len(rows):
                continue
            top, bottom, last = rows[0], rows[-1] + 1, end[rows[0]]
            if (bottom - top) * (last - begin[top]) <= self._SMALL:
                few[rows] = True
                continue
            for r in range(top, bottom, height):
                left = self.rows(ready, r, min(r + height, bottom))
                own = begin[r : r + len(left)]
                for c in range(own[0], last, height):
                    score = left @ self.rows(ready, c, min(c + height, last)).T
                    good = score > self.floor() - self._MARGIN
                    if c < own[-1]:
                        good &= np.arange(c, c + score.shape[1]) >= own[:, None]
                    a, b = np.nonzero(good)
                    for at in range(0, len(a), _STEP_PAIRS):
                        yield r + a[at : at + _STEP_PAIRS], c + b[at : at + _STEP_PAIRS]
        yield from _index_pairs(begin, np.where(few, count, 0))

    def width(self, ready: object) -> int:
        """Length of the vectors."""
        return ready[0].shape[1]

    def rows(self, ready: object, start: int, stop: int) -> np.ndarray:
        """Some of the vectors as a dense single-precision block."""
        return ready[0][start:stop].astype(np.float32)

    @staticmethod
    def exact(matrix: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        score = np.empty(len(i))
        step = max(1, 4_000_000 // max(matrix.shape[1], 1))
        for at in range(0, len(i), step):
            part = slice(at, at + step)
            score[part] = np.einsum("ij,ij->i", matrix[i[part]], matrix[j[part]])
        return np.round(score, 9)


@dataclass
class CosineAbove(Products):
    """Pairs of vectors whose cosine is above a threshold; the best ``keep_best`` if given.

    With ``keep_best`` every task emits only pairs that are among the best of what it has seen,
    which still holds every pair of the overall best ``keep_best``.
    """

    threshold: float
    vector: str = "vector"
    keep_best: int | None = None
    fields: list[T.StructField] = field(default_factory=lambda: [T.StructField("cosine", T.DoubleType())])

    def __post_init__(self) -> None:
        self._best = np.empty(0)

    def floor(self) -> float:
        full = self.keep_best is not None and len(self._best) >= self.keep_best
        return float(self._best.min()) if full else self.threshold

    def prepare(self, rows: pd.DataFrame, ids: np.ndarray) -> object:
        matrix = np.asarray(rows[self.vector].tolist(), dtype=np.float64)
        length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        # a vector without length has no cosine: it becomes NaN and passes no comparison
        with np.errstate(divide="ignore", invalid="ignore"):
            return matrix / length[:, None], ids

    def keep(self, ready: object, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        matrix, ids = ready
        score = self.exact(matrix, i, j)
        kept = np.flatnonzero((score > self.threshold) & (score >= self.floor()))
        if self.keep_best is not None:
            if len(kept) > self.keep_best:
                best = np.lexsort((ids[j[kept]], ids[i[kept]], -score[kept]))
                kept = kept[best[: self.keep_best]]
            self._best = np.sort(np.concatenate([self._best, score[kept]]))[-self.keep_best :]
        return kept, {"cosine": score[kept]}
