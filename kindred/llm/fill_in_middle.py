"""Fill-in-the-middle texts by displacement scatter, and the exact way back.

A text of ``n`` code points is cut at two places into prefix, middle and suffix and written anew:

    psm     <P> prefix <S> suffix <M> middle
    spm     <S> suffix <P> prefix <M> middle
    plain   the text as it is

Cuts and form follow from the first four 8-digit groups h1 to h4 of the hex SHA-256 of ``1:`` and the
decimal id: the cuts are h1 % (n + 1) and h2 % (n + 1), the text stays plain where h3 % 100 is at least
``rate`` or where it is empty or holds a marker, and is spm where h4 % 100 is below ``spm_rate``.

All texts of an Arrow batch lie behind one another in one buffer. One scan finds the code points and so the
bytes of the cuts. Every part of a text moves as a whole, so the shift of a byte changes only at cuts: the
changes are put into a difference array, whose cumulative sum is the shift of every byte, and a numpy scatter
writes the bytes to their new places. The way back finds the three markers of an output, lays the same
differences over the text to be rebuilt, and gathers every byte from where it lies. Both go over the buffer in
tiles, so the arrays of shifts are of bounded size and memory is the texts of a batch and their outputs.

A marker in an output is never ambiguous: no text with a marker is rewritten, and as a marker has ``<`` only
in front, none can begin in a part and end in a marker.

Defined results: a null text is the empty text, which is plain; a null id counts as the empty decimal; rows
of one id are cut by the same numbers, repeated rows give repeated results; texts are never cut short, the
longest is worked through in tiles; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.text import pieces, utf8

# The markers of prefix, suffix and middle.
MARKERS = (b"<P>", b"<S>", b"<M>")
PSM, SPM = (0, 1, 2), (1, 0, 2)  # the order of the markers
PLAIN_FROM, SPM_BELOW = 90, 20
TILE_BYTES = 1 << 18
_WIDTH = 3


def id_numbers(doc_id: Column, seed: str = "1") -> list[Column]:
    """h1 to h4 of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))


def _marker_starts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all markers in ``raw``, and which marker it is; a marker may cross the end of a text."""
    last = max(0, len(raw) - _WIDTH + 1)
    at = np.flatnonzero((raw[:last] == MARKERS[0][0]) & (raw[2 : last + 2] == MARKERS[0][2]))
    letter = raw[at + 1]
    kind = np.full(len(at), -1)
    for k, marker in enumerate(MARKERS):
        kind[letter == marker[1]] = k
    return at[kind >= 0], kind[kind >= 0]


def _inside(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The text of every marker start, -1 where the marker does not end in the text it begins in."""
    text = np.searchsorted(offsets, starts, side="right") - 1
    return np.where(starts + _WIDTH <= offsets[text + 1], text, -1)


def _char_starts(raw: np.ndarray) -> np.ndarray:
    return (raw & np.uint8(0xC0)) != 0x80


def _chars(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of code points of every text."""
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    held = np.flatnonzero(np.diff(offsets))
    if len(held):
        out[held] = np.add.reduceat(_char_starts(raw), offsets[held], dtype=np.int64)
    return out


def _cut_bytes(raw: np.ndarray, offsets: np.ndarray, chars: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The byte at which code point ``cuts`` of its text begins; the text's end where there is no such code point."""
    out = np.broadcast_to(offsets[1:], cuts.shape).copy()
    wanted = np.cumsum(chars) - chars + cuts  # the number of the code point in the buffer
    inside = cuts < chars
    seen = 0
    for lo in range(0, len(raw), TILE_BYTES):
        at = np.flatnonzero(_char_starts(raw[lo : lo + TILE_BYTES])) + lo
        here = inside & (wanted >= seen) & (wanted < seen + len(at))
        out[here] = at[wanted[here] - seen]
        seen += len(at)
    return out


def _moves(n: int, at: np.ndarray, change: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Tiles of a buffer of ``n`` bytes with the shift of every byte: differences ``change`` at ``at``, summed."""
    order = np.argsort(at, kind="stable")
    at, change = at[order], change[order]
    carry = 0
    for lo in range(0, n, TILE_BYTES):
        hi = min(n, lo + TILE_BYTES)
        a, b = np.searchsorted(at, [lo, hi])
        shift = np.zeros(hi - lo, dtype=np.int64)
        np.add.at(shift, at[a:b] - lo, change[a:b])
        shift[0] += carry
        np.cumsum(shift, out=shift)
        carry = int(shift[-1])
        yield lo, hi, shift


def _part_shifts(source: np.ndarray, target: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where shifts change and by how much, for parts given in the order of their ``source``."""
    held = lengths.ravel() > 0
    at, shift = source.ravel()[held], (target - source).ravel()[held]
    return at, np.diff(shift, prepend=0)


def scatter(raw: np.ndarray, offsets: np.ndarray, cuts: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs of the texts ``raw[offsets]`` and their offsets.

    ``cuts`` are two rows of bytes, ``form`` is 0 for plain, 1 for psm, 2 for spm.
    """
    a, b = cuts
    source = np.stack([offsets[:-1], a, b], axis=1)  # prefix, middle, suffix
    lengths = np.diff(np.concatenate([source, offsets[1:, None]], axis=1), axis=1)
    prefix, middle, suffix = lengths.T
    marks = np.where(form > 0, _WIDTH, 0)
    out_offsets = np.concatenate([[0], np.cumsum(np.diff(offsets) + 3 * marks)])
    begin = out_offsets[:-1]
    to_prefix = begin + marks + np.where(form == 2, suffix + marks, 0)
    to_suffix = begin + marks + np.where(form == 1, prefix + marks, np.where(form == 0, prefix + middle, 0))
    to_middle = begin + np.where(form > 0, prefix + suffix + 3 * marks, prefix)
    out = np.empty(int(out_offsets[-1]), dtype=np.uint8)
    for lo, hi, shift in _moves(len(raw), *_part_shifts(source, np.stack([to_prefix, to_middle, to_suffix], axis=1), lengths)):
        shift += np.arange(lo, hi)
        out[shift] = raw[lo:hi]
    moved = form > 0
    for marker, place in zip(MARKERS, (to_prefix, to_suffix, to_middle), strict=True):
        for k in range(_WIDTH):
            out[place[moved] - _WIDTH + k] = marker[k]
    return out, out_offsets


def gather(raw: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts behind the outputs ``raw[offsets]``, and their offsets: the inverse of :func:`scatter`."""
    starts, kind = _marker_starts(raw)
    text = _inside(starts, offsets)
    used = (text >= 0) & (form[text] > 0)
    place = np.broadcast_to(offsets[:-1, None], (len(form), 3)).copy()  # of prefix, suffix and middle marker
    place[text[used], kind[used]] = starts[used]
    moved = form > 0
    marks = np.where(moved, _WIDTH, 0)
    p, s, m = place.T
    end = offsets[1:]
    source = np.stack([p + marks, m + marks, s + marks], axis=1)  # prefix, middle, suffix
    prefix = np.where(form == 1, s, np.where(form == 2, m, end)) - source[:, 0]
    suffix = np.where(form == 1, m, np.where(form == 2, p, source[:, 2])) - source[:, 2]
    middle = np.where(moved, end - source[:, 1], 0)
    lengths = np.stack([prefix, middle, suffix], axis=1)
    out_offsets = np.concatenate([[0], np.cumsum(lengths.sum(axis=1))])
    target = out_offsets[:-1, None] + np.cumsum(lengths, axis=1) - lengths
    out = np.empty(int(out_offsets[-1]), dtype=np.uint8)
    # parts in the order of the rebuilt text: the shift leads from there to the output
    for lo, hi, shift in _moves(len(out), *_part_shifts(target, source, lengths)):
        shift += np.arange(lo, hi)
        out[lo:hi] = raw[shift]
    return out, out_offsets


FORMS = ("plain", "psm", "spm")
FORMATTED = "doc_id {id}, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW
) -> DataFrame:
    """Per row of ``docs``: the id, ``n`` code points, ``form``, ``prefix_chars`` and ``middle_chars``
    (null where plain) and ``output``."""
    h1, h2, h3, h4 = id_numbers(F.col(id_col))
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), h1.alias("h1"), h2.alias("h2"),
        (h3 % 100 < plain_from).alias("moved"), (h4 % 100 < spm_below).alias("suffix_first"),
    )

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, all_offsets = utf8(batch.column("text"))
            for lo, hi in pieces(all_offsets):
                raw, offsets = data[all_offsets[lo] : all_offsets[hi]], all_offsets[lo : hi + 1] - all_offsets[lo]
                rows = batch.slice(lo, hi - lo)
                h = np.stack([rows.column(c).to_numpy() for c in ("h1", "h2")])
                chars = _chars(raw, offsets)
                text = _inside(_marker_starts(raw)[0], offsets)
                moved = rows.column("moved").to_numpy(zero_copy_only=False) & (chars > 0)
                moved[text[text >= 0]] = False
                form = np.where(moved, 1 + rows.column("suffix_first").to_numpy(zero_copy_only=False), 0)
                cuts = np.sort(h % (chars + 1), axis=0)
                out, out_offsets = scatter(raw, offsets, _cut_bytes(raw, offsets, chars, cuts), form)
                plain = ~moved
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"), pa.array(chars), pa.array(np.array(FORMS)[form].tolist(), pa.string()),
                        pa.array(cuts[0], mask=plain), pa.array(cuts[1] - cuts[0], mask=plain),
                        _strings(out, out_offsets).cast(pa.string()),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(rewrite, FORMATTED.format(id=kind)).withColumnRenamed("doc_id", id_col)


def restore(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``restored`` for ``output``: the text rebuilt from ``output`` and ``form`` alone."""
    others = [c for c in formatted.columns if c != "output"]

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, all_offsets = utf8(batch.column("output"))
            for lo, hi in pieces(all_offsets):
                rows = batch.slice(lo, hi - lo)
                form = np.array([FORMS.index(f) for f in rows.column("form").to_pylist()], dtype=np.int64)
                raw, offsets = data[all_offsets[lo] : all_offsets[hi]], all_offsets[lo : hi + 1] - all_offsets[lo]
                texts = _strings(*gather(raw, offsets, form)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in others), texts], [*others, "restored"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in formatted.schema.fields if f.name != "output")
    return formatted.select(*others, "output").mapInArrow(rebuild, f"{schema}, restored string")
