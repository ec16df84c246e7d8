"""Words, shingles and their 64-bit hashes over Arrow text columns, in numpy.

A batch is worked through in pieces of a few megabytes, so memory follows the longest single text,
not the batch. Words are maximal runs of bytes other than space, tab and the line and page breaks
(0x09 to 0x0D); A-Z are lowered. A shingle is five words; a text of one to four words has its whole
sequence as one shingle; a text without words has none. Null counts as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE_WORDS = 5
PIECE_BYTES = 2 << 20
_TILE = 1 << 19
_U = np.uint64

_BYTE = np.random.default_rng(20_011).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_MULT = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for tiles of up to ``n`` bytes."""
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n, _TILE) + 1
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            tables.append(np.multiply.accumulate(row))
        _powers[:] = tables
    return _powers[0], _powers[1]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its values; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), where.astype(np.int64)


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of values that hold at most ``limit`` bytes, or one value."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def lower(raw: np.ndarray) -> np.ndarray:
    return raw | (((raw - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in ``raw``, and the index of every text's first word (n + 1 values)."""
    inside = (raw != 32) & ((raw - np.uint8(9)) >= 5)
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    before, after = edge.copy(), edge[1:].copy()
    before[1:] |= np.concatenate([~inside, [True]])[: len(raw)]
    after[: len(raw) - 1 if len(raw) else 0] |= ~inside[1:]
    starts = np.flatnonzero(inside & before[: len(raw)])
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word."""
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        at = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, at + _TILE, side="right")))
        part = raw[at : ends[hi - 1]]
        power, inverse = _tables(len(part))
        sums = np.empty(len(part) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[part] * power[: len(part)], out=sums[1:])
        s, e = starts[lo:hi] - at, ends[lo:hi] - at
        out[lo:hi] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def batch_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per piece of a column: the range of its texts, the word hashes, and each text's first word."""
    data, offsets = utf8(column)
    for lo, hi in pieces(offsets):
        raw = lower(data[offsets[lo] : offsets[hi]])
        starts, ends, first = word_spans(raw, offsets[lo : hi + 1] - offsets[lo])
        yield lo, hi, hash_words(raw, starts, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingle beginning at each word that begins one, in order; each text's first shingle (n + 1 values)."""
    k, n = SHINGLE_WORDS, len(words)
    counts = np.diff(first)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total += padded[j : j + n] * _MULT[j]
    begins = np.arange(n) + k <= np.repeat(first[1:], counts)
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        at, m = first[d], counts[d]
        total[at] = np.sum(words[at : at + m] * _MULT[:m], dtype=np.uint64) + _U(m)
        begins[at] = True
    per_text = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    return mix(total[begins]), np.concatenate([[0], np.cumsum(per_text)])


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Index and sorted distinct shingle hashes of every text of a column."""
    for lo, hi, words, first in batch_words(column):
        hashes, at = shingle_hashes(words, first)
        for d in range(hi - lo):
            yield lo + d, np.unique(hashes[at[d] : at[d + 1]])
