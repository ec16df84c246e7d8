"""Token ids packed into rows of fixed length.

Texts become ids of a public byte-level vocabulary, with one end id per document. A document longer
than a row is split losslessly into pieces of at most one row; the pieces of a document keep their
number, so joining them in order gives its ids back. Pieces are dealt by hash into shards of
bounded size, by id, number and, where an id occurs again in a batch, by its place there, so many rows of one id
or without one do not meet in a shard. A shard is packed best-fit-decreasing: the longest piece first, each into the
fullest row that still takes it, found in a segment tree over the free capacities.

A result row is one row of an id matrix: ``ids`` (little-endian, ``row_tokens`` values, padded),
``cu_seqlens`` (cumulative segment lengths, 0 first), ``position_ids`` (little-endian 32-bit, from 0
in every segment and in the padding), the ``doc_ids`` and ``pieces`` of its segments, ``n_tokens``.

The vocabulary is read once, by the driver, and broadcast (a megabyte or two), so executors need no such file.

Defined results: ties in length are packed in the order of id, number and ids; a null or empty text is its end id alone; repeated rows are packed as often as
they come; a null id stays null in ``doc_ids``; a text of any length is split into as many pieces as it needs;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_TOKENS = 2048
SHARD_BYTES = 16 << 20
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level vocabularies of this family cut a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_BYTES = 48 << 20
_ENTRY_BYTES = 200  # of a kept word, besides its letters and ids
_BLANK_THEN_SPACE = re.compile(r" \s")


class Tokenizer:
    """Ids of whole texts, equal to the vocabulary's own encoding of the text.

    A space before a word belongs to the word, so a text whose spaces stand alone can be cut before
    every space. The words of a batch that are not known yet are encoded in one go, and kept until
    there are too many. Other texts are encoded as a whole.
    """

    def __init__(self, vocabulary: bytes) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines())}
        self.end = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2" if self.end < 1 << 16 else "<u4")
        self.encoding = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.opens_word = np.zeros(self.end + 1, dtype=bool)
        self.opens_word[[rank for token, rank in ranks.items() if token[:1] == b" "]] = True
        self.end_bytes = np.asarray([self.end], dtype=self.dtype).tobytes()
        self.words: dict[str, bytes] = {}
        self.held = 0

    def whole(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(self.dtype).tobytes()

    def _learn(self, words: list[str]) -> None:
        if self.held > CACHE_BYTES:
            self.words.clear()
            self.held = 0
        ids = self.encoding.encode_to_numpy(" " + " ".join(words), disallowed_special=())
        width = self.dtype.itemsize
        at = (np.flatnonzero(self.opens_word[ids]) * width).tolist()
        data = ids.astype(self.dtype).tobytes()
        self.held += len(data) + sum(map(len, words)) + _ENTRY_BYTES * len(words)
        self.words.update(zip(words, map(data.__getitem__, map(slice, at, [*at[1:], len(data)])), strict=True))

    def __call__(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of every text and the end id, as bytes; texts are taken a megabyte at a time."""
        group: list[str] = []
        held = 0
        for text in texts:
            group.append(text or "")
            held += len(group[-1])
            if held > 1 << 20:
                yield from self._group(group)
                group, held = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        cut = [None if _BLANK_THEN_SPACE.search(t) or not t.strip() else t.split(" ") for t in texts]
        new = set()
        for words in cut:
            if words:
                new.update(words[1:])
        new.discard("")
        missing = sorted(new.difference(self.words))
        if missing:
            self._learn(missing)
            if len(missing) < len(new) and not new.issubset(self.words):  # the others were just forgotten
                self._learn(sorted(new.difference(self.words)))
        for text, words in zip(texts, cut, strict=True):
            if words is None:
                yield (self.whole(text) if text else b"") + self.end_bytes
            else:
                tail = self.whole(" ") if words[-1] == "" and len(words) > 1 else b""
                known = map(self.words.__getitem__, words[1:-1] if tail else words[1:])
                yield (self.whole(words[0]) if words[0] else b"") + b"".join(known) + tail + self.end_bytes


_loaded: dict[int, Tokenizer] = {}


def _known(vocabulary: bytes) -> Tokenizer:
    """One tokenizer per process and vocabulary."""
    key = zlib.crc32(vocabulary)
    if key not in _loaded:
        _loaded[key] = Tokenizer(vocabulary)
    return _loaded[key]


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a vocabulary file of this machine."""
    return _known(Path(path).read_bytes())


def sent_vocabulary(spark: SparkSession, path: str) -> Broadcast[bytes]:
    """The vocabulary file at ``path``, on the driver's machine or in any store that Spark reads."""
    if os.path.exists(path):
        return spark.sparkContext.broadcast(Path(path).read_bytes())
    return spark.sparkContext.broadcast(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def token_pieces(docs: DataFrame, row_tokens: int = ROW_TOKENS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, again, n_tokens, ids) with pieces of at most ``row_tokens`` ids.

    ``again`` counts the rows of the same id before in the batch.
    """
    sent = sent_vocabulary(docs.sparkSession, vocabulary)
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    names = ["doc_id", "piece", "again", "n_tokens", "ids"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _known(sent.value)
        step = row_tokens * tok.dtype.itemsize
        for batch in batches:
            ids = batch.column(0).to_pylist()
            seen: dict[int | None, int] = {}
            out, held = tuple([] for _ in names), 0
            for k, (doc, data) in enumerate(zip(ids, tok(x.as_py() for x in batch.column(1)), strict=True)):
                again = seen[doc] = seen.get(doc, -1) + 1
                for piece, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    for column, value in zip(out, (doc, piece, again, len(part) // tok.dtype.itemsize, part), strict=True):
                        column.append(value)
                    held += len(part)
                if held > 4 << 20 or k == len(ids) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)
                    out, held = tuple([] for _ in names), 0

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(encode, "doc_id long, piece int, again int, n_tokens int, ids binary")


class Capacities:
    """Rows by free capacity, with a segment tree that finds the smallest capacity that is enough."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._count(capacity, 1)

    def _count(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.tree[at] += by
            at >>= 1

    def take(self, need: int) -> tuple[int, int]:
        """Remove the row of the smallest capacity >= ``need``; (capacity, row), or (-1, -1)."""
        at = need + self.leaves
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return -1, -1
            at += 1
            while at < self.leaves:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._count(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(lengths: list[int], row_tokens: int) -> list[list[int]]:
    """Rows of piece numbers; ``lengths`` come in decreasing order, none above ``row_tokens``."""
    free, rows = Capacities(row_tokens), []
    for piece, length in enumerate(lengths):
        capacity, row = free.take(length)
        if row < 0:
            capacity, row = row_tokens, len(rows)
            rows.append([])
        rows[row].append(piece)
        if capacity > length:
            free.add(capacity - length, row)
    return rows


def _binary_rows(matrix: np.ndarray) -> pa.Array:
    """Every row of a matrix as one binary value, without a copy."""
    step = matrix.shape[1] * matrix.itemsize
    at = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(step)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(at), pa.py_buffer(matrix)])


PACKED = (
    "shard long, row int, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, "
    "doc_ids array<long>, pieces array<int>"
)


def pack_tokens(
    docs: DataFrame, row_tokens: int = ROW_TOKENS, vocabulary: str = VOCABULARY, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """``docs`` (doc_id, text) as packed rows, see the module."""
    total = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 1
    shards = -(-int(total) // shard_bytes)
    pieces = token_pieces(docs, row_tokens, vocabulary).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "again"), F.lit(shards)))
    sent = sent_vocabulary(docs.sparkSession, vocabulary)

    def pack(table: pa.Table) -> pa.Table:
        tok = _known(sent.value)
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids", "ascending")])
        table = table.combine_chunks()
        rows = best_fit_decreasing(table.column("n_tokens").to_pylist(), row_tokens)
        order = np.fromiter((k for row in rows for k in row), dtype=np.int64, count=table.num_rows)
        segments = table.drop_columns(["ids"]).take(order)
        lengths = segments.column("n_tokens").to_numpy()
        first = np.cumsum([0, *map(len, rows)])  # the first segment of every row
        row_of = np.repeat(np.arange(len(rows)), np.diff(first))
        ends = np.cumsum(lengths)
        used = np.diff(ends[first[1:] - 1], prepend=0)
        within = ends - lengths - (np.cumsum(used) - used)[row_of]
        # the id matrix is written in place, segment by segment
        matrix = np.full((len(rows), row_tokens), tok.end, dtype=tok.dtype)
        source = table.column("ids").chunk(0)
        for row, at, n, k in zip(row_of.tolist(), within.tolist(), lengths.tolist(), order.tolist(), strict=True):
            matrix[row, at : at + n] = np.frombuffer(source[k].as_buffer(), dtype=tok.dtype)
        begin = np.zeros((len(rows), row_tokens), dtype="<i4")
        begin[row_of, within] = within
        padded = np.flatnonzero(used < row_tokens)
        begin[padded, used[padded]] = used[padded]
        np.maximum.accumulate(begin, axis=1, out=begin)
        np.subtract(np.arange(row_tokens, dtype="<i4"), begin, out=begin)
        cu = np.insert(within + lengths, first[:-1], 0).astype(np.int32)
        lists = lambda values, at: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
        column = lambda name: segments.column(name).combine_chunks()
        return pa.table(
            {
                "shard": pa.array(np.full(len(rows), table.column("shard")[0].as_py(), dtype=np.int64)),
                "row": pa.array(np.arange(len(rows), dtype=np.int32)),
                "n_tokens": pa.array(used.astype(np.int32)),
                "ids": _binary_rows(matrix),
                "cu_seqlens": lists(pa.array(cu), first + np.arange(len(first))),
                "position_ids": _binary_rows(begin),
                "doc_ids": lists(column("doc_id"), first),
                "pieces": lists(column("piece"), first),
            }
        )

    return pieces.groupBy("shard").applyInArrow(pack, PACKED)


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, piece, ids) of every segment, for reading the documents back."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [])
            for row in batch.to_pylist():
                width = len(row["ids"]) * 4 // len(row["position_ids"])
                for doc, piece, a, b in zip(row["doc_ids"], row["pieces"], row["cu_seqlens"], row["cu_seqlens"][1:], strict=False):
                    for column, value in zip(out, (doc, piece, row["ids"][a * width : b * width]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "piece", "ids"])

    return packed.select("ids", "position_ids", "cu_seqlens", "doc_ids", "pieces").mapInArrow(cut, "doc_id long, piece int, ids binary")
