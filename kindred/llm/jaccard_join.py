"""Near duplicates by a Jaccard metric-space join.

Texts are sets of word shingles; the distance is one minus the Jaccard similarity, a metric, and two
texts link when it is at most 1 - 80/100. Equal sets become one point first.

*Singleton pivots.* The first pivots are the sets {s} of one shingle. A point's nearest pivots are its
own shingles, all equally far; the tie is broken by a fixed order of all shingles, the rare before the
frequent, and the first is the point's home region. Points within the radius differ from a point of
n shingles in at most n - ceil(0.8 n) of its own, so the window that follows from the triangle
inequality replicates a boundary point into the regions of its first n - ceil(0.8 n) + 1 pivots, and
any two points that link meet in the region of their first common shingle. The frequencies behind the
order come from all texts, counted in a fixed number of cells; the order only has to be the same
everywhere, so cells shared by several shingles cost nothing but a less rare first pivot.
A pair whose preceding shingle is the same in both has met in that region already and is left to it.

*Point pivots.* Inside the regions pivots are points. Every point is measured exactly against its
region's pivots; those within the radius are linked, and links are closed to components. Regions
whose points are all of one component are finished: no further link can change the result. Another
region is cut into the Voronoi cells of its pivots: a point belongs to the cell of the nearest one and is
replicated to every cell whose pivot is at most twice the radius farther, which by the triangle
inequality is wherever a point linked to it may be at home. Cells are joined in the same way,
recursively, until they are small or cutting no longer separates them. There, points of different
components are compared if sizes, the ring around the cell's pivot (distances to it may differ by the
radius at most) and a parity sketch (its differing bits never exceed the differing shingles) allow a
link, and compared exactly.

Nothing is capped: a region of any size is measured against its pivots in time linear in its points.
Only tables with a fixed bound reach the driver: the cells and a bit map of ids.

Shingles are told apart by 64-bit hashes, equal sets by 128 bits more.

Defined results: a text without words, null included, has no shingles, is linked with nothing and is
its own component; one to four words are one shingle; repeated rows, also of one id, are one point and
each gets a row; a null id is never another row's component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.closure import connected_components
from kindred.llm.text import mix, shingle_sets
from kindred.session import cut_lineage

PERCENT = 80  # intersection against union
CELL_BITS, SLICES = 20, 16
SKETCH_BITS = 1024
PIVOTS = 4
FOLDED_WORDS = 8
SMALL_REGION = 64
MAP_BITS = 26
_U = np.uint64


def _int64(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _set_keys(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    if not len(hashes):
        return 0, 0
    one, two = mix(hashes ^ _U(0xA24BAED4963EE407)), mix(hashes + _U(0x9FB21C651E98DF25))
    return tuple(np.array([np.bitwise_xor.reduce(one), np.sum(two, dtype=np.uint64)], dtype=np.uint64).view(np.int64).tolist())


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each of 1,024 classes, in 64-bit words."""
    odd = np.bincount((hashes & _U(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


PROFILE = "doc_id long, n long, k1 long, k2 long, sketch array<long>, slice int, cells binary"


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text its size, name and sketch; per task the frequencies of all shingles, in slices."""
    cells = np.zeros(1 << CELL_BITS, dtype=np.uint32)
    none = pa.nulls
    for batch in batches:
        rows = []
        for k, hashes in shingle_sets(batch.column(1)):
            np.add.at(cells, (hashes >> _U(64 - CELL_BITS)).astype(np.int64), np.uint32(1))
            rows.append((len(hashes), *_set_keys(hashes), _sketch(hashes)))
        size, k1, k2, sketch = zip(*rows, strict=True) if rows else ((), (), (), ())
        m = len(rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sketch, pa.list_(pa.int64())), none(m, pa.int32()), none(m, pa.binary())],
            ["doc_id", "n", "k1", "k2", "sketch", "slice", "cells"],
        )
    parts = [x.astype("<u4").tobytes() for x in np.split(cells, SLICES)]
    yield pa.RecordBatch.from_arrays(
        [none(SLICES, pa.int64()), none(SLICES, pa.int64()), none(SLICES, pa.int64()), none(SLICES, pa.int64()), none(SLICES, pa.list_(pa.int64())), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())],
        ["doc_id", "n", "k1", "k2", "sketch", "slice", "cells"],
    )


def _add_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = np.frombuffer(blob.as_py(), "<u4").astype(np.uint64)
            total[at] = total[at] + counts if at in total else counts
    blobs = [np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes() for x in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(blobs, pa.binary())], ["slice", "cells"])


def _frequencies(profiles: DataFrame) -> np.ndarray:
    """The cells of all texts: 4 MB, whatever the corpus."""
    parts = profiles.where("slice is not null").select("slice", "cells").repartition(SLICES, "slice")
    cells = np.zeros((SLICES, (1 << CELL_BITS) // SLICES), dtype=np.uint32)
    for row in parts.mapInArrow(_add_cells, "slice int, cells binary").collect():
        cells[row.slice] = np.frombuffer(row.cells, "<u4")
    return cells.reshape(-1)


WINDOW = "region long, doc long, n long, pos long, prev long"


def _windows(points: DataFrame, cells: np.ndarray) -> DataFrame:
    """A row for every region that a point (doc_id, text, k1, k2) lies in or is replicated to."""
    known = points.sparkSession.sparkContext.broadcast(cells)

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = known.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            named = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            out: tuple[list, ...] = ([], [], [], [], [])
            held = 0

            def flush(out=out) -> pa.RecordBatch:
                region, doc, n, pos, prev = (np.concatenate(x) for x in out)
                for x in out:
                    x.clear()
                first = pa.array(pos == 0)
                return pa.RecordBatch.from_arrays(
                    [_int64(region), pa.array(doc), pa.array(n), pa.array(pos), pa.compute.if_else(first, pa.scalar(None, pa.int64()), _int64(prev))],
                    ["region", "doc", "n", "pos", "prev"],
                )

            for (k, hashes), name in zip(shingle_sets(batch.column(1)), named, strict=True):
                n = len(hashes)
                if not n or _set_keys(hashes) != name:  # another text of a repeated id
                    continue
                order = np.argsort(counts[(hashes >> _U(64 - CELL_BITS)).astype(np.int64)], kind="stable")
                m = n - (PERCENT * n + 99) // 100 + 1
                region = hashes[order[:m]]
                for column, value in zip(out, (region, np.full(m, ids[k]), np.full(m, n), np.arange(m), np.concatenate([region[:1], region[:-1]])), strict=True):
                    column.append(value)
                held += m
                if held > 200_000:
                    yield flush()
                    held = 0
            if held:
                yield flush()

    return points.select("doc_id", "text", "k1", "k2").mapInArrow(regions, WINDOW)


def _shared_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by region, those of regions in which two points meet for the first time.

    A region is left out if it has one row, or if all its rows have the same preceding shingle.
    At most one region's rows are held, and only until they differ.
    """
    waiting: list[pa.RecordBatch] = []  # rows of the region the stream is in, all alike so far
    region = prev = None
    meets = False

    for batch in batches:
        regions = batch.column(0).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(regions[1:] != regions[:-1]) + 1])
        sizes = np.diff(np.append(starts, len(batch)))
        prevs = batch.column(4)
        null = prevs.is_null().to_numpy(zero_copy_only=False)
        values = prevs.fill_null(0).to_numpy()
        # a row differs from the one before in its region if either begins there or has another predecessor
        differs = np.zeros(len(batch), dtype=bool)
        differs[1:] = (regions[1:] == regions[:-1]) & (null[1:] | null[:-1] | (values[1:] != values[:-1]))
        mixed = np.add.reduceat(differs, starts) > 0
        keep = np.repeat(mixed, sizes)
        begin = 0
        if region is not None and regions[0] == region:  # the open region goes on
            own = slice(0, sizes[0])
            step = bool(null[0]) or prev is None or int(values[0]) != prev
            if meets or step or mixed[0]:
                yield from waiting
                waiting = []
                meets = True
                keep[own] = True
            else:
                keep[own] = False
                waiting.append(batch.slice(0, int(sizes[0])))
            begin = 1
        if len(starts) > begin:  # another region began
            waiting, last = [], int(starts[-1])
            region, meets = int(regions[last]), bool(mixed[-1])
            if not meets:
                keep[last:] = False
                waiting = [batch.slice(last)]
        prev = None if null[-1] else int(values[-1])
        if sum(map(len, waiting)) > 100_000:  # rather too many rows than too much memory
            yield from waiting
            waiting, meets = [], True
        if keep.any():
            yield batch.filter(pa.array(keep))


def _differing_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _bit_map(ids: DataFrame, column: str) -> np.ndarray:
    """A map of 2**MAP_BITS bits with the bits of all ids set: 8 MB, whatever their number."""
    slot = F.pmod(F.xxhash64(column), F.lit(1 << MAP_BITS))
    words = ids.select((slot / 64).cast("int").alias("word"), (slot % 64).cast("int").alias("bit")).groupBy("word").agg(
        F.expr("bit_or(shiftleft(1L, bit))").alias("bits")
    )
    out = np.zeros((1 << MAP_BITS) // 64, dtype=np.int64)
    for row in words.toLocalIterator():
        out[row.word] = row.bits
    return out


SETS = "doc long, hashes binary"


def _sets(docs: DataFrame, points: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, hashes) of the points ``wanted`` (doc); the texts are read again, not shuffled."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_bit_map(wanted, "doc"))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << MAP_BITS)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            hit = (known[at >> 6] >> (at & 63).astype(np.int64)) & 1
            part = batch.filter(pa.array(hit.astype(bool)))
            if not part.num_rows:
                continue
            names, sets, ids = [], [], part.column(0).to_pylist()
            for k, hashes in shingle_sets(part.column(1)):
                names.append((ids[k], *_set_keys(hashes)))
                sets.append(hashes.tobytes())
                if k == len(ids) - 1 or len(sets) == 500:
                    doc, k1, k2 = (pa.array(x, pa.int64()) for x in zip(*names, strict=True))
                    yield pa.RecordBatch.from_arrays([doc, k1, k2, pa.array(sets, pa.binary())], ["doc", "k1", "k2", "hashes"])
                    names, sets = [], []

    read = docs.where("doc_id is not null").select("doc_id", "text", slot.alias("slot")).mapInArrow(run, "doc long, k1 long, k2 long, hashes binary")
    own = points.join(wanted, points["doc_id"] == wanted["doc"]).select("doc", "k1", "k2")
    return cut_lineage(read.join(own, ["doc", "k1", "k2"]).dropDuplicates(["doc"]).select("doc", "hashes"))


def _measure(pairs: DataFrame, docs: DataFrame, points: DataFrame) -> DataFrame:
    """``pairs`` (a, b, distinct) with the exact ``shared`` and ``united`` numbers of shingles."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    sets = _sets(docs, points, ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, united = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                shared.append(both)
                united.append(len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int32()), pa.array(united, pa.int32())], ["a", "b", "shared", "united"])

    left = sets.select(F.col("doc").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("hashes").alias("y"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return cut_lineage(met.mapInArrow(run, "a long, b long, shared int, united int"))


LINKED = f"100 * cast(shared as bigint) >= {PERCENT} * cast(united as bigint)"


def _sketch_filter(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose sketches and sizes allow a link."""
    a = points.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("wa"))
    b = points.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("wb"))
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT
    # |x ^ y| <= (1 - t) |x u y| and |x u y| = (|x| + |y| + |x ^ y|) / 2
    most = (F.col("na") + F.col("nb")) * (100 - PERCENT)
    return (
        pairs.join(a, "a").join(b, "b").where(fits)
        .where(_differing_bits(F.col("wa"), F.col("wb")) * (100 + PERCENT) <= most)
        .select("a", "b")
    )


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


RADIUS = 1 - PERCENT / 100
_SLACK = 1e-9  # distances are doubles


def _links(docs: DataFrame, points: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) that connect what all links connect."""
    folded = F.transform(
        F.sequence(F.lit(0), F.lit(FOLDED_WORDS - 1)),
        lambda i: F.get("sketch", i).bitwiseXOR(F.get("sketch", i + FOLDED_WORDS)),
    )
    sketches = points.select(F.col("doc_id").alias("doc"), folded.alias("sketch"))
    links = members.select(F.col("doc").alias("a"), F.col("doc").alias("b")).limit(0)
    # d: distance to the pivot of the cell; flat: cutting does not separate the region
    regions = members.withColumn("d", F.lit(None).cast("double")).withColumn("flat", F.lit(False))
    turn = 0
    while True:
        # pivots: the points first by some hashes; the same points in regions that share them
        first = [F.min(F.struct(F.xxhash64("doc", F.lit(101 * turn + j)).alias("h"), "doc"))["doc"].alias(f"p{j}") for j in range(PIVOTS if turn else 1)]
        pivots = cut_lineage(regions.groupBy("region").agg(*first).select("region", F.array_distinct(F.array(*[f"p{j}" for j in range(len(first))])).alias("pivots")))
        spokes = regions.join(pivots, "region").select("region", "doc", F.explode("pivots").alias("pivot"))
        spokes = cut_lineage(spokes.select("region", "doc", "pivot", *_ordered("doc", "pivot")))
        asked = spokes.where("a <> b").select("a", "b").distinct()
        if turn == 0:  # links are all that is wanted of the first round, so what cannot link is not measured
            asked = _sketch_filter(asked, points)
        measured = _measure(cut_lineage(asked), docs, points)
        links = cut_lineage(links.unionByName(measured.where(LINKED).select("a", "b")))
        labels = cut_lineage(connected_components(links))
        named = regions.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        named = cut_lineage(named)
        left = named.groupBy("region", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("region")
        left = left.agg(F.sum("c").alias("size"), F.count(F.lit(1)).alias("kinds"), F.max(F.struct("c", "component"))["component"].alias("main"))
        unfinished = cut_lineage(left.where("kinds > 1").select("region", "size", "main"))
        if unfinished.isEmpty():
            return links
        regions = cut_lineage(named.join(unfinished, "region"))
        if turn:
            regions = cut_lineage(_cells(regions, spokes, measured))
        ready = regions.where(f"flat or size <= {SMALL_REGION}")
        links = links.unionByName(_compare(docs, points, sketches, ready))
        regions = cut_lineage(regions.where(f"not flat and size > {SMALL_REGION}").drop("component", "size", "main"))
        if regions.isEmpty():
            return links
        turn += 1


def _cells(regions: DataFrame, spokes: DataFrame, measured: DataFrame) -> DataFrame:
    """Regions cut into the Voronoi cells of their pivots.

    First the points of a region's largest component whose distance to some pivot differs by more
    than the radius from that of every point outside the component are let go: they have no links
    but inside it. A region is flat if a cell would hold most of it; it stays as it is, with the
    distances to one pivot.
    """
    far = F.when(F.col("doc") == F.col("pivot"), 0.0).otherwise(1 - F.col("shared") / F.col("united"))
    known = spokes.join(measured, ["a", "b"], "left").select("region", "doc", F.struct("pivot", far.alias("d")).alias("at"))
    placed = known.groupBy("region", "doc").agg(F.sort_array(F.collect_list("at")).alias("at"))
    rows = cut_lineage(regions.drop("d", "flat").join(placed, ["region", "doc"]))
    outside = F.col("component") != F.col("main")
    bounds = rows.groupBy("region").agg(
        *[
            f(F.when(outside, F.get(F.col("at"), F.lit(j))["d"])).alias(f"{name}{j}")
            for j in range(PIVOTS)
            for name, f in (("lo", F.min), ("hi", F.max))
        ]
    )
    near = outside
    within = F.lit(True)
    for j in range(PIVOTS):
        d = F.get(F.col("at"), F.lit(j))["d"]
        within = within & F.coalesce((d >= F.col(f"lo{j}") - RADIUS - _SLACK) & (d <= F.col(f"hi{j}") + RADIUS + _SLACK), F.lit(True))
    kept = rows.join(bounds, "region").where(near | within).drop(*[f"{n}{j}" for n in ("lo", "hi") for j in range(PIVOTS)])
    least = F.array_min(F.transform("at", lambda x: x["d"]))
    kept = cut_lineage(kept.withColumn("cells", F.filter("at", lambda x: x["d"] <= least + 2 * RADIUS + _SLACK)).drop("size"))
    sizes = kept.groupBy("region").agg(
        F.count(F.lit(1)).alias("size"),
        *[
            F.sum(F.array_contains(F.transform("cells", lambda x: x["pivot"]), F.get(F.col("at"), F.lit(j))["pivot"]).cast("long")).alias(f"n{j}")
            for j in range(PIVOTS)
        ],
    )
    most = F.greatest(*[F.coalesce(f"n{j}", F.lit(0)) for j in range(PIVOTS)])
    judged = kept.join(sizes.select("region", "size", (most > 0.8 * F.col("size")).alias("flat")), "region")
    # one cell of a flat region stands for all
    cells = F.when(F.col("flat"), F.slice("at", 1, 1)).otherwise(F.col("cells"))
    cut = judged.withColumn("cell", F.explode(cells)).drop("at", "cells", "size")
    cut = cut.withColumn("region", F.xxhash64("region", "cell.pivot")).withColumn("d", F.col("cell.d")).drop("cell", "main")
    cut = cut_lineage(cut)
    left = cut.groupBy("region", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("region")
    left = left.agg(F.sum("c").alias("size"), F.count(F.lit(1)).alias("kinds"), F.max(F.struct("c", "component"))["component"].alias("main"))
    return cut.join(left.where("kinds > 1").drop("kinds"), "region")


def _compare(docs: DataFrame, points: DataFrame, sketches: DataFrame, regions: DataFrame) -> DataFrame:
    """Links between points of different components of one region."""
    all_ = cut_lineage(regions.select("region", "doc", "n", "pos", "prev", "component", "d", "main").join(sketches, "doc"))
    others = all_.where("component <> main").drop("main")
    others = others.select(*[F.col(c).alias(f"o_{c}") for c in others.columns])
    fits = F.least("n", "o_n") * 100 >= F.greatest("n", "o_n") * PERCENT
    once = (F.col("component") == F.col("main")) | (F.col("doc") < F.col("o_doc"))
    new = F.col("prev").isNull() | F.col("o_prev").isNull() | (F.col("prev") != F.col("o_prev"))
    ring = F.coalesce(F.abs(F.col("d") - F.col("o_d")) <= RADIUS + _SLACK, F.lit(True))
    # the shingles before the first common one are not shared
    most = (F.col("n") + F.col("o_n")) * (100 - PERCENT)
    before = (F.col("pos") + F.col("o_pos")) * (100 + PERCENT) <= most
    alike = _differing_bits(F.col("sketch"), F.col("o_sketch")) * (100 + PERCENT) <= most
    met = all_.join(others, F.col("region") == F.col("o_region")).where(
        (F.col("component") != F.col("o_component")) & once & fits & new & ring & before & alike
    )
    asked = cut_lineage(met.select(*_ordered("doc", "o_doc")).distinct())
    return _measure(cut_lineage(_sketch_filter(asked, points)), docs, points).where(LINKED).select("a", "b")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profiles = cut_lineage(source.mapInArrow(_profiles, PROFILE))
    rows = profiles.where("slice is null")
    name = ["n", "k1", "k2"]
    points = cut_lineage(
        rows.where("n > 0 and doc_id is not null").groupBy(*name).agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"))
    )
    texts = source.join(points.select("doc_id", "k1", "k2"), "doc_id")
    windows = _windows(texts, _frequencies(profiles))
    sorted_ = windows.repartition(F.col("region")).sortWithinPartitions("region")
    members = cut_lineage(sorted_.mapInArrow(_shared_regions, WINDOW))
    labels = connected_components(_links(source, points, members))
    classes = cut_lineage(
        points.join(labels, points["doc_id"] == labels["node"], "left").select(*name, F.coalesce("component", "doc_id").alias("component_id"))
    )
    return rows.join(classes, name, "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
