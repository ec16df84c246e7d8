"""String similarity for batches of pairs, as numpy code inside Arrow UDFs.

Texts are encoded once, as code points behind one another. Pairs are measured in steps of similar length, each step a
padded matrix of bounded size, so one long text does not widen the others. Jaro-Winkler walks the positions of the
left texts and handles all pairs of a step at each position; the matching-blocks ratio finds the longest common
stretch of all open parts of all pairs at once, and goes on with what is left and right of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values of the Jaro-Winkler measure
BOOST_FLOOR = 0.7
PREFIX_WEIGHT = 0.1
PREFIX_LENGTH = 4

# fixed values of the matching-blocks ratio: in right texts of so many characters or more, those that make up more than a
# hundredth of it begin no stretch
POPULAR_FROM, POPULAR_SHARE = 200, 100

_PAIRS_PER_STEP = 200_000
_STEP_CELLS = 2_000_000

# texts of so many characters have their places in the bits of one number; pairs of them in a step, and bytes of a table of places
_BITS = 64
_BIT_PAIRS = 1 << 15
_TABLE_BYTES = 64_000_000

_MASK_CELLS = 1 << 17
_GROUP_TEXTS = 64
_KNOWN_PAIRS = 1_000_000


@lru_cache(64)
def _windows(width: int, reach: int, kind: np.dtype) -> np.ndarray:
    """Bits of the places up to ``r`` away from ``k``, for all ``k`` and ``r``."""
    bits = kind.itemsize * 8
    return np.array([[((1 << (k + r + 1)) - (1 << max(k - r, 0))) % (1 << bits) for r in range(reach + 1)] for k in range(width)], dtype=kind)


class Encoded:
    """Distinct texts as code points, lengths and 64-bit character masks."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.length = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        # one more, so that every start is a place
        self.flat = np.append(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.uint32(0))
        self.head = self.rows(np.arange(len(texts)), PREFIX_LENGTH)
        self._mask: np.ndarray | None = None
        self._places: tuple | None = None
        self._known: np.ndarray | None = None
        self._begins: list[np.ndarray] | None = None

    def rows(self, which: np.ndarray, width: int, begin: np.ndarray | int = 0) -> np.ndarray:
        """``width`` code points of some texts from ``begin`` on, as a matrix; 0 beyond their ends."""
        place = begin + np.zeros(len(which), dtype=np.int64)
        at = np.arange(width)
        inside = at < (self.length[which] - place)[:, None]
        return np.where(inside, self.flat[np.where(inside, (self.start[which] + place)[:, None] + at, 0)], np.uint32(0))

    @property
    def mask(self) -> np.ndarray:
        """One bit per (character, how often it was seen before), folded into 64 bits."""
        if self._mask is None:
            text = np.repeat(np.arange(len(self.texts)), self.length)
            code = self.flat[:-1]
            order = np.lexsort((code, text))  # stable, so equal characters stay in their order
            new = np.ones(len(order), dtype=bool)
            new[1:] = (code[order][1:] != code[order][:-1]) | (text[order][1:] != text[order][:-1])
            first = np.flatnonzero(new)
            seen = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            bit = (code[order].astype(np.uint64) * np.uint64(37) + seen.astype(np.uint64) * np.uint64(11)) % np.uint64(64)
            self._mask = np.zeros(len(self.texts), dtype=np.uint64)
            held = np.flatnonzero(self.length)
            if len(held):
                self._mask[held] = np.bitwise_or.reduceat(np.uint64(1) << bit, self.start[held])
        return self._mask

    def common_bound(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Upper bound of the number of characters two texts share.

        A bit that is set on one side only stands for at least one character that the other
        text lacks; folding can hide such characters but never invent one.
        """
        a, b = self.mask[i], self.mask[j]
        only_a = np.bitwise_count(a & ~b).astype(np.int64)
        only_b = np.bitwise_count(b & ~a).astype(np.int64)
        return np.minimum(self.length[i] - only_a, self.length[j] - only_b)

    def prefix(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix, at most ``PREFIX_LENGTH``."""
        if self._begins is None:
            # a number per beginning of 1, 2, ... characters; none for shorter texts
            self._begins, before = [], np.zeros(len(self.texts), dtype=np.int64)
            for k in range(PREFIX_LENGTH):
                before = np.unique(before * np.int64(2**21) + self.head[:, k], return_inverse=True)[1]
                self._begins.append(np.where(self.length > k, before, -1).astype(np.int32))
        out = np.zeros(len(i), dtype=np.int64)
        for begin in self._begins:
            a = begin.take(i)
            out += (a == begin.take(j)) & (a >= 0)
        return out

    def jaro_winkler_bound(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Upper bound of :meth:`jaro_winkler`, from shared characters and the true prefix."""
        common = self.common_bound(i, j)
        la, lb = np.maximum(self.length[i], 1), np.maximum(self.length[j], 1)
        jaro = np.where(common > 0, (common / la + common / lb + 1.0) / 3.0, 0.0)
        boosted = jaro + self.prefix(i, j) * PREFIX_WEIGHT * (1.0 - jaro)
        return np.where(jaro > BOOST_FLOOR, boosted, jaro) + 1e-12

    def jaro_winkler_above(self, i: np.ndarray, j: np.ndarray, floor: float) -> np.ndarray:
        """Positions of the pairs whose :meth:`jaro_winkler_bound` is above ``floor``; prefixes are compared only where
        the longest one could lift the pair above it."""
        common = self.common_bound(i, j)
        la, lb = np.maximum(self.length[i], 1), np.maximum(self.length[j], 1)
        jaro = np.where(common > 0, (common / la + common / lb + 1.0) / 3.0, 0.0)
        most = np.where(jaro > BOOST_FLOOR, jaro + PREFIX_LENGTH * PREFIX_WEIGHT * (1.0 - jaro), jaro)
        some = np.flatnonzero(most > floor - 1e-9)
        return some[self.jaro_winkler_bound(i[some], j[some]) > floor]

    @property
    def places(self) -> tuple:
        """Of texts of up to ``_BITS`` characters: where each character of the alphabet stands, as bits of one number (0 for
        a character that a text lacks), and per place the character, the last one where a text has ended. Without a
        table if it were too large."""
        if self._places is None:
            short = np.flatnonzero(self.length <= _BITS)
            longest = int(self.length[short].max(initial=0))
            kind = np.dtype(next(f"u{b // 8}" for b in (16, 32, 64) if longest <= b))
            alphabet, codes = np.unique(self.flat[:-1], return_inverse=True)
            size = len(alphabet) + 1
            if len(self.texts) * size * kind.itemsize > _TABLE_BYTES:
                self._places = (None, None, size)
                return self._places
            table = np.zeros((len(self.texts), size), dtype=kind)
            at = np.full((max(longest, 1), len(self.texts)), size - 1, dtype=np.int64)
            for k in range(longest):
                held = short[self.length[short] > k]
                at[k, held] = codes[self.start[held] + k]
                table[held, at[k, held]] |= kind.type(1 << k)
            self._places = (table.ravel(), at, size)
        return self._places

    def likely(self, x: np.ndarray, y: np.ndarray, floor: float, inner: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions in ``x`` and ``y`` (texts, each once) of the pairs whose :meth:`jaro_winkler_bound` is above ``floor``; if
        ``inner``, where both are the same, every pair and every text with itself in one order only.

        Texts of about the same length stand together. Two such groups need so many common characters for the best
        possible prefix, and more without one; the counts of set and of common bits tell, for whole blocks of pairs, which
        cannot have them.
        """
        jaro = min(floor, max(BOOST_FLOOR, (floor - PREFIX_LENGTH * PREFIX_WEIGHT) / (1.0 - PREFIX_LENGTH * PREFIX_WEIGHT)))

        def needed(jaro: float, a: int, b: int) -> int:
            return max(int(np.floor((3.0 * jaro - 1.0) * a * b / (a + b) - 1e-9)) + 1, 1) if floor >= 0 else 0

        sides = []
        for texts in (x, y):
            order = np.argsort(self.length[texts], kind="stable")
            mask, length = self.mask[texts[order]], self.length[texts[order]]
            letter = (self.head[texts[order], 0] & 255).astype(np.uint8)  # equal for equal first characters
            sides.append((order, mask, length, letter, np.bitwise_count(mask) - length, self._groups(length)))
        (order, mask, length, letter, spare, groups), (order_y, mask_y, length_y, letter_y, spare_y, groups_y) = sides
        found, n = [], 0
        for begin, end in groups:
            for begin_y, end_y in groups_y:
                if inner and begin_y < begin:
                    continue
                a, b = max(length[begin], 1), max(length_y[begin_y], 1)
                common, alone = needed(jaro, a, b), needed(floor, a, b)
                if common > min(length[end - 1], length_y[end_y - 1]):
                    continue
                at_least = lambda n: (np.clip(s + n, 0, 255).astype(np.uint8) for s in (spare, spare_y))
                (need, need_y), (need_alone, need_alone_y) = at_least(common), at_least(alone)
                wide = min(end_y - begin_y, _MASK_CELLS)
                high = max(1, _MASK_CELLS // wide)
                for r in range(begin, end, high):
                    rows = slice(r, min(r + high, end))
                    for c in range(max(begin_y, r) if inner else begin_y, end_y, wide):
                        cols = slice(c, min(c + wide, end_y))
                        both = np.bitwise_count(mask[rows, None] & mask_y[None, cols])
                        good = both >= need_y[None, cols]
                        good &= both >= need[rows, None]
                        if alone > common:
                            more = both >= need_alone_y[None, cols]
                            more &= both >= need_alone[rows, None]
                            more |= letter[rows, None] == letter_y[None, cols]
                            good &= more
                        at = np.flatnonzero(good)
                        p = at // (cols.stop - c)
                        p, q = r + p, c + at - p * (cols.stop - c)
                        if inner and c < rows.stop:
                            once = p <= q
                            p, q = p[once], q[once]
                        p, q = order[p], order_y[q]
                        some = self.jaro_winkler_bound(x[p], y[q]) > floor
                        found.append((p[some], q[some]))
                        n += len(found[-1][0])
                        if n >= _PAIRS_PER_STEP:
                            yield tuple(map(np.concatenate, zip(*found, strict=True)))
                            found, n = [], 0
        if n:
            yield tuple(map(np.concatenate, zip(*found, strict=True)))

    @staticmethod
    def _groups(length: np.ndarray) -> list[tuple[int, int]]:
        """Begin and end of stretches of equal lengths (``length`` is sorted), small ones together."""
        out, begin = [], 0
        for end in [*(np.flatnonzero(np.diff(length)) + 1).tolist(), len(length)]:
            if end - begin >= _GROUP_TEXTS or end == len(length):
                out.append((begin, end))
                begin = end
        return out if len(length) else []

    def similarity(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """:meth:`jaro_winkler`, once per distinct pair of texts; of few texts what was measured is kept."""
        n = len(self.texts)
        if n * n > _KNOWN_PAIRS:
            left, right, back = distinct_pairs(i, j, n)
            return self.jaro_winkler(left, right)[back]
        if self._known is None:
            self._known = np.full(n * n, -1.0)
        keys = i.astype(np.int64) * n + j
        out = self._known[keys]
        if len(out) and out.min() < 0:
            there = np.zeros(n * n, dtype=bool)
            there[keys[out < 0]] = True
            new = np.flatnonzero(there)
            self._known[new] = self.jaro_winkler(new // n, new % n)
            out = self._known[keys]
        return out

    def jaro_winkler(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Jaro-Winkler similarity of pairs of texts; the same for both orders of a pair."""
        out = np.zeros(len(i))
        short = (self.length[i] <= _BITS) & (self.length[j] <= _BITS) if self.length.max(initial=0) > _BITS else np.ones(len(i), dtype=bool)
        if not short.any() or self.places[0] is None:
            return self._jaro_winkler_long(i, j)
        if not short.all():
            out[short], out[~short] = self.jaro_winkler(i[short], j[short]), self._jaro_winkler_long(i[~short], j[~short])
            return out
        for at in range(0, len(i), _BIT_PAIRS):
            step = slice(at, at + _BIT_PAIRS)
            out[step] = self._jaro_winkler_bits(i[step], j[step])
        return out

    def _jaro_winkler_bits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """As :meth:`_jaro_winkler`, with the places of the right text as the bits of one number."""
        table, codes, size = self.places
        la, lb = self.length[i], self.length[j]
        wa = int(la.max(initial=0))
        if not wa or not lb.max(initial=0):
            return np.zeros(len(i))
        kind = table.dtype
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        row = j * size
        near = _windows(wa, int(reach.max()), kind)
        free = np.full(len(i), np.iinfo(kind).max, dtype=kind)
        held, taken = np.empty((2, wa, len(i)), dtype=kind)
        prefix, same = np.zeros(len(i)), la > 0
        for k in range(wa):
            code = codes[k].take(i)
            table.take(row + code, out=held[k])
            found = held[k] & near[k].take(reach) & free
            np.bitwise_and(found, np.negative(found), out=taken[k])
            free ^= taken[k]
            if k < PREFIX_LENGTH:
                same &= (code == codes[k].take(j)) & (code < size - 1)
                prefix += same
        rest = ~free
        m = np.bitwise_count(rest).astype(np.int64)
        moved = np.zeros(len(i), dtype=np.uint8)
        for k in range(wa):
            got = taken[k] != 0
            first = rest & np.negative(rest)  # the matched places of both sides, in their own order
            moved += got & ((first & held[k]) == 0)
            rest ^= first * got
        t = moved // 2
        safe = np.maximum(m, 1)
        jaro = (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - t) / safe) / 3.0
        jaro = np.where(m > 0, jaro, 0.0)
        boosted = jaro + prefix * PREFIX_WEIGHT * (1.0 - jaro)
        return np.where(jaro > BOOST_FLOOR, boosted, jaro)

    def _jaro_winkler_long(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i))
        # pairs of similar length together, so that short texts are not padded to the longest
        order = np.argsort(np.maximum(self.length[i], self.length[j]), kind="stable")
        start = 0
        while start < len(order):
            step = order[start : start + _PAIRS_PER_STEP]
            widest = int(max(self.length[i[step[-1]]], self.length[j[step[-1]]], 1))
            room = max(1, min(len(step), 16_000_000 // (widest * widest)))
            step = order[start : start + room]
            out[step] = self._jaro_winkler(i[step], j[step])
            start += len(step)
        return out

    def _jaro_winkler(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        la, lb = self.length[i], self.length[j]
        wa, wb = int(la.max(initial=0)), int(lb.max(initial=0))
        if not wa or not wb:
            return np.zeros(len(i))
        a, b = self.rows(i, wa), self.rows(j, wb)
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        at = np.arange(wb)
        free = at < lb[:, None]
        hit_a = np.zeros(a.shape, dtype=bool)
        rows = np.arange(len(i))
        for k in range(wa):
            near = np.abs(at - k) <= reach[:, None]
            found = free & near & (b == a[:, k : k + 1]) & (k < la)[:, None]
            first = found.argmax(axis=1)
            got = found[rows, first]
            hit_a[:, k] = got
            free[rows[got], first[got]] = False
        hit_b = ~free & (at < lb[:, None])
        m = hit_a.sum(axis=1)
        # matched characters of both sides, pushed to the front in their own order
        seq_a = np.take_along_axis(a, np.argsort(~hit_a, axis=1, kind="stable"), axis=1)
        seq_b = np.take_along_axis(b, np.argsort(~hit_b, axis=1, kind="stable"), axis=1)
        width = min(wa, wb)
        moved = (seq_a[:, :width] != seq_b[:, :width]) & (np.arange(width) < m[:, None])
        t = moved.sum(axis=1) // 2
        safe = np.maximum(m, 1)
        jaro = (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - t) / safe) / 3.0
        jaro = np.where(m > 0, jaro, 0.0)
        boosted = jaro + self.prefix(i, j) * PREFIX_WEIGHT * (1.0 - jaro)
        return np.where(jaro > BOOST_FLOOR, boosted, jaro)

    def ratio(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Twice the characters in matching blocks by all characters; 1 for two empty texts.

        The longest common stretch of two texts is a block (of equally long ones the first in the left text, then the
        first in the right one), and so on in what is left and in what is right of it.
        """
        total = self.length[i] + self.length[j]
        return np.where(total > 0, 2.0 * self._matched(i, j) / np.maximum(total, 1), 1.0)

    def _popular(self, j: np.ndarray) -> dict[int, np.ndarray]:
        """Per long text the characters that begin no stretch in it."""
        out = {}
        for text in np.unique(j[self.length[j] >= POPULAR_FROM]).tolist():
            codes, counts = np.unique(self.flat[self.start[text] : self.start[text] + self.length[text]], return_counts=True)
            out[text] = codes[counts > self.length[text] // POPULAR_SHARE + 1]
        return out

    def _matched(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        matched = np.zeros(len(i), dtype=np.int64)
        popular = self._popular(j)
        # open parts of pairs: pair, begin and end in the left text, begin and end in the right one
        parts = np.stack([np.arange(len(i)), np.zeros(len(i), np.int64), self.length[i], np.zeros(len(i), np.int64), self.length[j]])
        while True:
            parts = parts[:, (parts[1] < parts[2]) & (parts[3] < parts[4])]
            if not parts.shape[1]:
                return matched
            parts = parts[:, np.argsort(np.maximum(parts[2] - parts[1], parts[4] - parts[3]), kind="stable")]
            left, start = [], 0
            while start < parts.shape[1]:
                stop = min(start + _PAIRS_PER_STEP, parts.shape[1])
                widest = int(max(parts[2, stop - 1] - parts[1, stop - 1], parts[4, stop - 1] - parts[3, stop - 1]))
                stop = min(stop, start + max(1, _STEP_CELLS // widest))
                here = parts[:, start:stop]
                at, to, size = self._longest(i[here[0]], j[here[0]], here, popular)
                found = size > 0
                pair, a0, a1, b0, b1 = here[:, found]
                at, to, size = at[found], to[found], size[found]
                np.add.at(matched, pair, size)
                left += [np.stack([pair, a0, at, b0, to]), np.stack([pair, at + size, a1, to + size, b1])]
                start = stop
            parts = np.concatenate(left, axis=1)

    def _longest(self, i: np.ndarray, j: np.ndarray, parts: np.ndarray, popular: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the left and right text and length of the longest common stretch of every part."""
        _, a0, a1, b0, b1 = parts
        wa, wb = int((a1 - a0).max()), int((b1 - b0).max())
        a, b = self.rows(i, wa, a0).astype(np.int64), self.rows(j, wb, b0).astype(np.int64)
        a[np.arange(wa) >= (a1 - a0)[:, None]] = -1
        b[np.arange(wb) >= (b1 - b0)[:, None]] = -2
        seeds = b
        if popular:
            seeds = b.copy()
            for row, text in enumerate(j.tolist()):
                if text in popular:
                    seeds[row, np.isin(b[row], popular[text])] = -2
        rows = np.arange(len(i))
        run = np.zeros((len(i), wb + 1), dtype=np.int32)  # of stretches that end here; one column ahead
        best, at, to = (np.zeros(len(i), dtype=np.int64) for _ in range(3))
        for k in range(wa):
            run[:, 1:] = np.where(seeds == a[:, k : k + 1], run[:, :-1] + 1, 0)
            end = run.argmax(axis=1)
            size = run[rows, end]
            better = size > best
            best[better] = size[better]
            at[better] = k + 1 - size[better]
            to[better] = end[better] - size[better]
        if popular:  # a stretch goes on over popular characters, to both sides; without one the beginnings are compared
            for back in (True, False):
                open_ = np.ones(len(i), dtype=bool)
                while open_.any():
                    x, y = (at - 1, to - 1) if back else (at + best, to + best)
                    open_ &= (x >= 0) & (y >= 0) & (x < wa) & (y < wb)
                    open_[open_] = a[rows[open_], x[open_]] == b[rows[open_], y[open_]]
                    best += open_
                    if back:
                        at, to = at - open_, to - open_
        return a0 + at, b0 + to, best

    def ratio_bound(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        total = self.length[i] + self.length[j]
        return np.where(total > 0, 2.0 * self.common_bound(i, j) / np.maximum(total, 1), 1.0) + 1e-12


def round_half_up(values: np.ndarray, digits: int) -> np.ndarray:
    """Decimal rounding as Spark does it, of values up to 1: half up on the shortest digits of the number."""
    scaled = values * 10.0**digits
    out = np.rint(scaled) / 10.0**digits
    for at in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5).tolist():
        out[at] = float(Decimal(repr(float(values[at]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def distinct_pairs(left: np.ndarray, right: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (left, right) code pairs and, for every input pair, where its own one is."""
    keys = left.astype(np.int64) * max(size, 1) + right
    if size * size <= 4 * len(keys):  # looked up, not sorted
        there = np.zeros(size * size, dtype=bool)
        there[keys] = True
        back = (np.cumsum(there) - 1)[keys]
        keys = np.flatnonzero(there)
    else:
        keys, back = np.unique(keys, return_inverse=True)
    return keys // max(size, 1), keys % max(size, 1), back


def _over_distinct(left: pd.Series, right: pd.Series, measure: str) -> np.ndarray:
    """``measure`` once per distinct pair of the batch; 0.0 where a side is missing."""
    codes, texts = pd.factorize(pd.concat([left, right], ignore_index=True))
    a, b = codes[: len(left)], codes[len(left) :]
    out = np.zeros(len(left))
    full = (a >= 0) & (b >= 0)
    if full.any():
        encoded = Encoded([str(t) for t in texts])
        i, j, back = distinct_pairs(a[full], b[full], len(texts))
        out[full] = getattr(encoded, measure)(i, j)[back]
    return out


def _measure(name: str, left: Column | str, right: Column | str) -> Column:
    """Arrow UDF over two text columns; made per use, so that it belongs to the running session."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_over_distinct(a, b, name))

    return F.pandas_udf(run, T.DoubleType())(left, right)


def jaro_winkler(left: Column | str, right: Column | str) -> Column:
    """Jaro-Winkler similarity; 0 where a side is missing."""
    return _measure("jaro_winkler", left, right)


def sequence_ratio(left: Column | str, right: Column | str) -> Column:
    """Matching-blocks ratio of the left text against the right one (not symmetric)."""
    return _measure("ratio", left, right)


def fuzzy_ratio(left: Column | str, right: Column | str) -> Column:
    """Matching-blocks ratio of the lower-cased texts as a whole number 0-100, 0 if one is missing."""
    return F.rint(sequence_ratio(F.lower(left), F.lower(right)) * 100).cast("int")


def exact(left: Column | str, right: Column | str) -> Column:
    """1 for equal values, 0 for others and for missing ones."""
    a = F.col(left) if isinstance(left, str) else left
    b = F.col(right) if isinstance(right, str) else right
    return F.coalesce((a == b).cast("int"), F.lit(0))


def levenshtein_similarity(left: Column | str, right: Column | str) -> Column:
    """1 - edits / longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(left), F.length(right))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(left, right) / longer)


def both_empty_zero(left: Column, right: Column, similarity: Column) -> Column:
    return F.when((left == "") & (right == ""), F.lit(0.0)).otherwise(similarity)
