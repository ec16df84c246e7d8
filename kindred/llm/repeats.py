"""Removal of long byte strings that occur more than once.

Every byte covered by a string of ``width`` bytes that also starts anywhere else, in the same text
or another, is removed; matches never cross texts and are judged on the input.

Column by column construction of a collection's Burrows-Wheeler order inserts one symbol of every
document per round and updates the order and the common prefixes. Over whole texts that would take as
many rounds as the longest text has bytes, and no order beyond ``width`` symbols is needed. So the
rounds run over short aligned stretches instead. Every window of ``width`` bytes has an anchor, the
32-byte string in it with the smallest hash (the first of several); windows with the same content
have the same anchor at the same place. Consecutive windows with one anchor form a stretch of at
most 368 bytes, and stretches with the same anchor are aligned by it. A group of aligned stretches is
a collection of short documents: its symbols are inserted column by column from the right, each
round sorting stably by the new symbol what is in order of the symbols to its right, and common
prefixes follow from the smallest common prefix passed over, plus one. A window is repeated exactly
when a neighbour in the order has ``width`` symbols in common with it. Groups are read from sorted shuffle
files, one after another, and only the groups of a few thousand stretches are in memory at a time.

Anchors that occur once cannot have a repeated window. Anchors are counted first, over all texts, and
a bit map of fixed size tells the second reading which stretches to send; it may send too many, never
too few. Of equal stretches in one tile of a megabyte (text that repeats itself every few bytes) one is
sent, marked as repeated, and the others are settled where they are, as one run if they adjoin. A group
of more than ``HOT`` stretches (wording that very many texts share) is taken apart into its windows,
which are counted by their 128-bit digests with combination on the map side.

Defined results: null is the empty text; texts shorter than ``width`` are kept whole; repeated rows
repeat each other, so all their windows go; rows of one id with different texts are told apart; an empty table
gives an empty result; what is kept need not be valid UTF-8 and is returned as bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.text import _BYTE, _tables, mix, utf8
from kindred.session import cut_lineage

WIDTH, GRAM = 200, 32
TILE_BYTES = 1 << 20
CHUNK, HOT = 16_384, 16_384
MAP_BITS = 26
_U = np.uint64
_POSITION_BITS = _U(24)


def _tiles(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Stretches of bytes with the texts in them: (text, begin, end, place of begin in the text).

    Short texts come together; a long text comes in tiles that overlap by ``width`` - 1 bytes.
    """
    group: list[tuple[int, int, int, int]] = []
    lo = 0
    for k in range(len(offsets) - 1):
        a, b = int(offsets[k]), int(offsets[k + 1])
        if group and b - lo > TILE_BYTES:
            yield data[lo : lo + group[-1][2]], group
            group = []
        if b - a > TILE_BYTES:
            for at in range(a, b - width + 1, TILE_BYTES):
                end = min(b, at + TILE_BYTES + width - 1)
                yield data[at:end], [(k, 0, end - at, at - a)]
            continue
        if not group:
            lo = a
        group.append((k, a - lo, b - lo, 0))
    if group:
        yield data[lo : lo + group[-1][2]], group


def _stretches(raw: np.ndarray, texts: list[tuple[int, int, int, int]], width: int):
    """(text number in ``texts``, anchor hash, anchor, first and last window start) of every stretch."""
    grams = len(raw) - GRAM + 1
    if len(raw) < width:
        return None
    power, inverse = _tables(len(raw))
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=sums[1:])
    hashes = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[:grams])
    keyed = hashes >> _POSITION_BITS << _POSITION_BITS | np.arange(grams, dtype=np.uint64)
    # smallest of every ``span`` neighbours, from running minima of blocks in both directions
    span = width - GRAM + 1
    blocks = -(-grams // span)
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:grams] = keyed
    table = padded.reshape(blocks, span)
    forward = np.minimum.accumulate(table, axis=1).reshape(-1)
    backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = len(raw) - width + 1
    anchor = (np.minimum(backward[:windows], forward[span - 1 : span - 1 + windows]) & ((_U(1) << _POSITION_BITS) - _U(1))).astype(np.int64)
    owner = np.full(windows, -1, dtype=np.int64)
    for number, (_, a, b, _) in enumerate(texts):
        if b - a >= width:
            owner[a : b - width + 1] = number
    edge = np.ones(windows, dtype=bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(edge)
    last = np.append(first[1:], windows) - 1
    kept = owner[first] >= 0
    first, last = first[kept], last[kept]
    return owner[first], hashes[anchor[first]], anchor[first], first, last


def _anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            found = [np.zeros(0, np.uint64)]
            for raw, texts in _tiles(data, offsets, width):
                if (s := _stretches(raw, texts, width)) is not None:
                    found.append(s[1])
            names, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts)], ["anchor", "c"])

    return run


def _repeated_anchors(texts: DataFrame, width: int) -> np.ndarray:
    """A bit map of 8 MB with the bits of all anchors that occur more than once."""
    counted = texts.select("text").mapInArrow(_anchors(width), "anchor long, c long").groupBy("anchor").agg(F.sum("c").alias("c"))
    slot = F.pmod("anchor", F.lit(1 << MAP_BITS))
    words = (
        counted.where("c > 1")
        .select((slot / 64).cast("int").alias("word"), (slot % 64).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    )
    out = np.zeros((1 << MAP_BITS) // 64, dtype=np.int64)
    for row in words.toLocalIterator():
        out[row.word] = row.bits
    return out


STRETCH = "anchor long, doc_id long, hash long, start long, lead int, body binary, twice boolean, n long"
NAMES = [c.split()[0] for c in STRETCH.split(", ")]


def _candidates(texts: DataFrame, bits: np.ndarray, width: int) -> DataFrame:
    """Stretches to compare (``body``), and runs of ``n`` window starts known to be repeated (no body)."""
    known = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = known.value
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            ids, hashes = batch.column(0), batch.column(1).to_numpy()
            for raw, parts in _tiles(data, offsets, width):
                if (s := _stretches(raw, parts, width)) is None:
                    continue
                owner, names, anchor, first, last = s
                slot = (names & _U((1 << MAP_BITS) - 1)).astype(np.int64)
                hit = np.flatnonzero((seen[slot >> 6] >> (slot & 63)) & 1)
                if not len(hit):
                    continue
                part = np.array(parts)[owner[hit]]
                text, start = part[:, 0], first[hit] - part[:, 1] + part[:, 3]
                lead, size = (anchor - first)[hit], (last - first)[hit] + 1
                whole = raw.tobytes()
                bodies = [whole[a:b] for a, b in zip(first[hit].tolist(), (last[hit] + width).tolist(), strict=True)]
                same: dict[tuple[int, bytes], list[int]] = {}
                for k, key in enumerate(zip(lead.tolist(), bodies, strict=True)):
                    same.setdefault(key, []).append(k)
                send = np.array([k[0] for k in same.values()])
                twice = np.array([len(k) > 1 for k in same.values()])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[hit][send].view(np.int64)), ids.take(pa.array(text[send])), pa.array(hashes[text[send]]),
                        pa.array(start[send]), pa.array(lead[send].astype(np.int32)), pa.array([bodies[k] for k in send], pa.binary()),
                        pa.array(twice), pa.array(size[send]),
                    ],
                    NAMES,
                )
                again = np.sort(np.array([k for own in same.values() if len(own) > 1 for k in own], dtype=np.int64))
                if not len(again):
                    continue
                opens = np.ones(len(again), dtype=bool)
                opens[1:] = (text[again][1:] != text[again][:-1]) | (start[again][1:] != (start + size)[again][:-1])
                begin = np.flatnonzero(opens)
                n, at = np.add.reduceat(size[again], begin), again[begin]
                spread = mix(hashes[text[at]].view(np.uint64) + start[at].astype(np.uint64))  # any task may pass them on
                none = pa.nulls
                m = len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(spread.view(np.int64)), ids.take(pa.array(text[at])), pa.array(hashes[text[at]]), pa.array(start[at]),
                        none(m, pa.int32()), none(m, pa.binary()), none(m, pa.bool_()), pa.array(n),
                    ],
                    NAMES,
                )

    return texts.select("doc_id", "hash", "text").mapInArrow(run, STRETCH)


def repeated_windows(groups: np.ndarray, leads: np.ndarray, bodies: list[bytes], width: int) -> np.ndarray:
    """For different stretches, aligned by group: which window starts are repeated (stretch x column).

    Column ``span - 1`` is the window that begins at the anchor. ``groups`` must not decrease.
    """
    span = width - GRAM + 1
    n, columns = len(bodies), span + width - 1
    sizes = np.fromiter(map(len, bodies), dtype=np.int64, count=n)
    begin = span - 1 - leads
    symbols = np.zeros((n, columns), dtype=np.uint16)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    symbols.reshape(-1)[np.repeat(np.arange(n) * columns + begin, sizes) + inside] = np.frombuffer(b"".join(bodies), np.uint8).astype(np.uint16) + 1
    symbols = np.ascontiguousarray(symbols.T)
    order, common = np.arange(n), np.zeros(n + 1, dtype=np.int32)  # common[k]: of order[k - 1] and order[k]
    repeated = np.zeros((n, span), dtype=bool)
    ends = begin + sizes
    for column in range(int(ends.max()) - 1, int(begin.min()) - 1, -1):
        symbol = symbols[column][order]
        key = groups[order] * 257 + symbol
        new = np.argsort(key, kind="stable")
        sorted_key = key[new]
        same = np.zeros(n + 1, dtype=bool)
        same[1:n] = (sorted_key[1:] == sorted_key[:-1]) & (symbol[new[1:]] > 0)
        at = np.flatnonzero(same)
        fresh = np.zeros(n + 1, dtype=np.int32)
        if len(at):
            passed = np.empty(2 * len(at), dtype=np.int64)
            passed[0::2], passed[1::2] = new[at - 1] + 1, new[at] + 1
            fresh[at] = np.minimum.reduceat(common, passed)[::2] + 1
        order, common = order[new], fresh
        if column < span:
            long_ = np.maximum(common[:-1], common[1:]) >= width
            repeated[order[long_], column] = True
    return repeated


FOUND = "doc_id long, hash long, start long, n long, h1 long, h2 long"


def _compare(width: int):
    span = width - GRAM + 1

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "hash", "start", "n", "h1", "h2"])

    def windows(row: tuple) -> list[tuple]:
        doc, text, start, _, body, *_ = row
        out = []
        for k in range(len(body) - width + 1):
            digest = np.frombuffer(hashlib.md5(body[k : k + width]).digest(), np.int64)
            out.append((doc, text, start + k, 1, int(digest[0]), int(digest[1])))
        return out

    def runs(pending: list[list[tuple]]) -> list[tuple]:
        groups, leads, bodies, owners, out = [], [], [], [], []
        for number, rows in enumerate(pending):
            same: dict[tuple[int, bytes], list[tuple]] = {}
            for row in rows:
                same.setdefault((row[3], row[4]), []).append(row)
            for (lead, body), held in same.items():
                one = len(held) == 1 and not held[0][5]
                if not one:  # those marked are settled already
                    out += [(r[0], r[1], r[2], r[6], None, None) for r in held if not r[5]]
                groups.append(number)
                leads.append(lead)
                bodies.append(body)
                owners.append(held[0] if one else None)
        if len(bodies) > len(pending):
            flags = repeated_windows(np.array(groups), np.array(leads), bodies, width)
            edges = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            rows_, begin = np.nonzero(edges == 1)
            _, end = np.nonzero(edges == -1)
            for k, a, b in zip(rows_.tolist(), begin.tolist(), end.tolist(), strict=True):
                if owners[k] is not None:
                    doc, text, start, lead, *_ = owners[k]
                    out.append((doc, text, start + a - (span - 1 - lead), b - a, None, None))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows, hot = None, [], False
        pending: list[list[tuple]] = []
        held = 0
        for batch in batches:
            out = []
            for anchor, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[4] is None:
                    out.append((row[0], row[1], row[2], row[6], None, None))
                    continue
                if anchor != name:
                    if len(rows) > 1:
                        pending.append(rows)
                        held += len(rows)
                        if held >= CHUNK:
                            out += runs(pending)
                            pending, held = [], 0
                    name, rows, hot = anchor, [], False
                if hot:
                    out += windows(tuple(row))
                else:
                    rows.append(tuple(row))
                    if len(rows) > HOT:
                        for lo in range(0, len(rows), 256):
                            yield batch_of([w for r in rows[lo : lo + 256] for w in windows(r)])
                        rows, hot = [], True
                if len(out) > 50_000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)
        if len(rows) > 1:
            pending.append(rows)
        if pending:
            yield batch_of(runs(pending))

    return run


KEPT = "doc_id long, n_bytes long, spans array<struct<start:bigint,length:bigint>>, kept binary"


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            starts, lengths, spans, kept = batch.column(2), batch.column(3), [], []
            for k in range(batch.num_rows):
                raw = data[offsets[k] : offsets[k + 1]]
                if not starts[k].is_valid:
                    spans.append([])
                    kept.append(raw.tobytes())
                    continue
                a, n = np.asarray(starts[k].values, np.int64), np.asarray(lengths[k].values, np.int64)
                depth = np.zeros(len(raw) + 1, dtype=np.int32)
                np.add.at(depth, a, 1)
                np.add.at(depth, a + n - 1 + width, -1)
                gone = np.cumsum(depth[:-1]) > 0
                edges = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
                spans.append([{"start": int(x), "length": int(y - x)} for x, y in zip(begin, end, strict=True)])
                kept.append(raw[~gone].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"]
            )

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, the removed ``spans`` and the ``kept`` bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("hash", F.xxhash64("text"))
    stretches = _candidates(texts, _repeated_anchors(texts, width), width)
    sorted_ = stretches.repartition(F.col("anchor")).sortWithinPartitions("anchor")
    ordered = sorted_.select(*NAMES)
    found = cut_lineage(ordered.mapInArrow(_compare(width), FOUND))
    windows = found.where("h1 is not null")
    shared = cut_lineage(windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h1", "h2"))
    hits = found.where("h1 is null").unionByName(windows.join(shared, ["h1", "h2"], "left_semi"))
    per_text = (
        hits.select("doc_id", "hash", "start", "n").distinct()
        .groupBy(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"))
        .agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("lengths"))
    )
    met = texts.join(per_text, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    return met.select("doc_id", "text", "starts", "lengths").mapInArrow(_cut(width), KEPT)
