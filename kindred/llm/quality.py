"""Document quality by a factorisation machine.

A document's features are its hashed words (logarithmic counts, length 1), structure statistics
of the whole text, and the table's ``n_chars``. A statistic falls between two of ``BINS`` knots and
counts for both by closeness, so the machine may bend along it. The score is

    sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2))

whose pairwise part costs time linear in the features. Identity, language, source and labels are
not features.

It is fitted on at most ``max_labelled`` labelled rows, drawn by the hash of their id (and of the row, where
many rows share an id): every partition runs a pass of stochastic gradient steps from the common parameters,
and the results are averaged, ``rounds`` times. The draw and all random numbers depend on ids only.

Defined results: null and empty texts have statistics of zero and are scored; null ``n_chars`` counts
as the text's length; rows without a label, or with a null one, are not learned from; equal
label rows count once; with nothing to learn from every score is 0.5; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.text import hash_words, lower, pieces, utf8, word_spans
from kindred.session import cut_lineage

WORD_BUCKETS, BINS, FACTORS = 1 << 14, 9, 8
# Byte classes counted per text: letters A-Z, digits, marks of ordinary prose, other ASCII marks, line ends, beyond ASCII.
UPPER, DIGIT, PROSE, MARK, LINE, WIDE = range(1, 7)
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[33:127] = MARK
_CLASS[97:123] = 0
_CLASS[65:91] = UPPER
_CLASS[48:58] = DIGIT
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = PROSE
_CLASS[[10, 13]] = LINE
_CLASS[128:] = WIDE
STATS = 15
PIECE_BYTES = 1 << 19
WIDTH = WORD_BUCKETS + STATS * BINS


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Shares on a scale from 0 to 1 that is fine near 0."""
    return np.log1p(1000 * part / np.maximum(whole, 1)) / np.log(1001)


def _size(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log1p(n) / np.log(1e6), 1.0)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbours in ``at``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _statistics(raw: np.ndarray, at: np.ndarray, spans: tuple, words: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    starts, ends, first = spans
    n_bytes, n_words = np.diff(at), np.diff(first)
    classes = _CLASS[raw]
    counts = {c: _sums(classes == c, at) for c in range(1, 7)}
    chars = n_bytes - _sums((raw & 0xC0) == 0x80, at)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((words, owner))
    fresh = np.ones(len(words), dtype=bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = _sums(fresh, first)
    short = _sums(ends - starts <= 2, first)
    lone = np.zeros(len(words), dtype=bool)  # words that are a single mark, such as table rules
    if len(words):
        lone = (ends - starts == 1) & (classes[starts] == MARK)
    n_chars = np.where(n_chars < 0, chars, n_chars)
    return np.stack(
        [
            _size(chars), _size(n_words), _size(counts[LINE]), _size(n_chars), _size(np.abs(n_chars - chars)),
            np.minimum(n_bytes / np.maximum(n_words, 1) / 24, 1.0),
            _share(counts[UPPER], n_bytes), _share(counts[DIGIT], n_bytes), _share(counts[PROSE], n_bytes),
            _share(counts[MARK], n_bytes), _share(counts[WIDE], n_bytes),
            _share(_sums(again, first), n_words), distinct / np.maximum(n_words, 1), _share(short, n_words),
            _share(_sums(lone, first), n_words),
        ],
        axis=1,
    )


def features(texts: pa.Array, n_chars: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per piece of a column: its range, then feature numbers, values, and where each text's begin."""
    data, offsets = utf8(texts)
    given = pc.fill_null(n_chars.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
    for lo, hi in pieces(offsets, PIECE_BYTES):
        at = offsets[lo : hi + 1] - offsets[lo]
        raw = data[offsets[lo] : offsets[hi]]
        small = lower(raw)
        spans = word_spans(small, at)
        words = hash_words(small, spans[0], spans[1])
        stats = _statistics(raw, at, spans, words, given[lo:hi])
        n = hi - lo
        owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(spans[2]))
        keys, tf = np.unique(owner * WORD_BUCKETS + (words >> np.uint64(50)).astype(np.int64), return_counts=True)
        value = np.log1p(tf).astype(np.float32)
        norm = np.sqrt(np.bincount(keys // WORD_BUCKETS, weights=value**2, minlength=n))
        value /= np.maximum(norm, 1e-9)[keys // WORD_BUCKETS].astype(np.float32)
        place = np.clip(stats, 0, 1) * (BINS - 1)
        knot = np.minimum(place.astype(np.int64), BINS - 2)
        base = WORD_BUCKETS + np.arange(STATS) * BINS + knot
        owners = np.concatenate([keys // WORD_BUCKETS, np.repeat(np.arange(n), 2 * STATS)])
        index = np.concatenate([keys % WORD_BUCKETS, np.stack([base, base + 1], axis=2).reshape(-1)])
        values = np.concatenate([value, np.stack([1 - place + knot, place - knot], axis=2).reshape(-1).astype(np.float32)])
        order = np.argsort(owners, kind="stable")
        yield lo, hi, index[order].astype(np.int32), values[order], np.searchsorted(owners[order], np.arange(n + 1))


class Machine:
    """Parameters of the factorisation machine."""

    def __init__(self, seed: int = 11) -> None:
        self.bias = np.zeros(1, dtype=np.float32)
        self.linear = np.zeros(WIDTH, dtype=np.float32)
        self.factors = np.random.default_rng(seed).normal(0, 0.02, (WIDTH, FACTORS)).astype(np.float32)

    def margins(self, index: np.ndarray, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of texts whose features begin at ``at``, and their factor sums."""
        scaled = self.factors[index] * values[:, None]
        sums = np.add.reduceat(scaled, at[:-1], axis=0)
        squares = np.add.reduceat((scaled * scaled).sum(axis=1), at[:-1])
        linear = np.add.reduceat(self.linear[index] * values, at[:-1])
        return self.bias[0] + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def learn(self, rows: list[tuple[np.ndarray, np.ndarray, float]], seed: int, rate: float, decay: float) -> None:
        """One pass of adaptive gradient steps over ``rows`` (features, values, label), 32 rows a step."""
        seen = [np.full(p.shape, 1e-2, dtype=np.float32) for p in (self.linear, self.factors)]
        order = np.random.default_rng(seed).permutation(len(rows))
        for lo in range(0, len(rows), 32):
            batch = [rows[k] for k in order[lo : lo + 32]]
            index = np.concatenate([b[0] for b in batch])
            values = np.concatenate([b[1] for b in batch])
            sizes = np.array([len(b[0]) for b in batch])
            margin, sums = self.margins(index, values, np.concatenate([[0], np.cumsum(sizes)]))
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - np.array([b[2] for b in batch])).astype(np.float32)
            each, owner = np.repeat(slope, sizes) * values, np.repeat(np.arange(len(batch)), sizes)
            steps = (each, each[:, None] * (sums[owner] - self.factors[index] * values[:, None]))
            self.bias -= 0.05 * slope.mean()
            hit, back = np.unique(index, return_inverse=True)
            for parameter, squares, step in zip((self.linear, self.factors), seen, steps, strict=True):
                total = np.zeros((len(hit), *step.shape[1:]), dtype=np.float32)
                np.add.at(total, back, step)
                total = total / len(batch) + decay * parameter[hit]
                squares[hit] += total * total
                parameter[hit] -= rate * total / np.sqrt(squares[hit])


def _features_table(docs: DataFrame, extra: list[str]) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, index, values, at in features(batch.column(0), batch.column(1)):
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for x in (index, values)]
                yield pa.RecordBatch.from_arrays([*lists, *[batch.column(2 + k).slice(lo, hi - lo) for k in range(len(extra))]], ["index", "value", *extra])

    kinds = dict(docs.dtypes)
    schema = ", ".join(["index array<int>", "value array<float>", *[f"{c} {kinds[c]}" for c in extra]])
    return docs.select("text", "n_chars", *extra).mapInArrow(rows, schema)


def _pass(current, turn: int, rate: float, decay: float) -> Callable:
    """One pass over a partition's rows from the parameters ``current``."""

    def learn(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id").combine_chunks()
        columns = ([np.asarray(x.values) for x in group.column(c)] for c in ("index", "value"))
        data = list(zip(*columns, group.column("label").to_pylist(), strict=True))
        own, known = Machine(), current.value
        own.bias, own.linear, own.factors = known.bias.copy(), known.linear.copy(), known.factors.copy()
        own.learn(data, turn * 1000 + key[0].as_py(), rate, decay)
        blob = np.concatenate([own.bias, own.linear, own.factors.ravel()]).astype("<f4").tobytes()
        return pa.table({"n": pa.array([len(data)], pa.int64()), "blob": pa.array([blob], pa.binary())})

    return learn


def _share_below(share: float, *key: Column | str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1_000_000)) < int(share * 1_000_000)


def _labelled(docs: DataFrame, labels: DataFrame, may_learn: Column, most: int) -> DataFrame:
    """At most about ``most`` rows of ``docs`` (doc_id, text, n_chars) with their ``label``, drawn by hashes."""
    usable = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & may_learn)
        .select("doc_id", F.col("quality").cast("double").alias("label"))
        .distinct()
    )
    known = usable.count()
    share = 1.0 if known <= most else 0.95 * most / known
    # bounded by ``most``, so it may be sent to every task; texts are not shuffled
    drawn = usable.where(_share_below(share, "doc_id", F.lit(3)))
    own = docs.select("doc_id", "text", "n_chars")  # other columns may have the names used here
    met = own.select("doc_id").join(F.broadcast(drawn), "doc_id").count()
    rows = own.join(F.broadcast(drawn), "doc_id")
    if met > most:  # many rows of one id
        rows = rows.where(_share_below(0.95 * most / met, "doc_id", "text", F.monotonically_increasing_id()))
    return rows


def fit(
    docs: DataFrame, labels: DataFrame, may_learn: Column, max_labelled: int = 20_000, rounds: int = 6, parts: int = 6,
    rate: float = 0.1, decay: float = 1e-5,
) -> Machine:
    """The machine learned from ``labels`` (doc_id, quality) where ``may_learn`` holds of the id."""
    machine = Machine()
    rows = _labelled(docs, labels, may_learn, max_labelled).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(parts)).cast("int"))
    table = cut_lineage(_features_table(rows, ["doc_id", "label", "part"]))
    spark = docs.sparkSession
    for turn in range(rounds):
        learn = _pass(spark.sparkContext.broadcast(machine), turn, rate / (1 + turn) ** 0.5, decay)
        learned = table.groupBy("part").applyInArrow(learn, "n long, blob binary").collect()  # ``parts`` rows
        if not learned:
            return machine
        total = sum(r.n for r in learned)
        mean = sum(np.frombuffer(r.blob, "<f4").astype(np.float64) * (r.n / total) for r in sorted(learned, key=lambda r: bytes(r.blob)))
        machine.bias = mean[:1].astype(np.float32)
        machine.linear = mean[1 : 1 + WIDTH].astype(np.float32)
        machine.factors = mean[1 + WIDTH :].reshape(WIDTH, FACTORS).astype(np.float32)
    return machine


def score(docs: DataFrame, machine: Machine, keep: list[str], name: str = "score") -> DataFrame:
    """Columns ``keep`` of ``docs`` (text, n_chars, ...) and the score as ``name``; nothing is shuffled.

    Only the text and its length go to the Python workers and only the score comes back.
    """
    known = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def scores(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, n_chars in batches:
            out = np.zeros(len(texts))
            for lo, hi, index, values, at in features(texts, n_chars):
                margin, _ = known.value.margins(index, values, at)
                out[lo:hi] = 1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -40, 40)))
            yield pa.array(out)

    found = scores(F.col("text").cast("string"), F.col("n_chars").cast("long"))
    return docs.select(*[F.col(f"`{c}`") for c in keep], found.alias(name))


def held_out(of: int) -> Callable[[Column], Column]:
    """Whether crc32 of the id as text leaves remainder 1; false for a null id."""
    return lambda doc_id: F.coalesce(F.crc32(doc_id.cast("string")) % of == 1, F.lit(False))
