"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

The probability of a token is that of its class given the words before it, times that of the token
in its class. The class part is a maximum-entropy model over hashed features of the history: the
word before, the one before that and the third (skips), the pair, and the last frequent word. The
most frequent words and the end of a text are classes of their own; other words fall into classes by
their spelling (first two and last four bytes, hashed), the spellings being clustered by the frequent
words they follow. Within a class, words have their smoothed relative frequency, and one place is
left for a word never seen:

    P(w | class) = (c(w) + 0.5) / (N(class) + 0.5 (V(class) + 1))

Counts, class statistics and gradients come from all training texts. The weights are trained in
``ROUNDS`` rounds, each over the training texts of one hash residue: every task runs adaptive gradient
steps over its texts from the common weights, and the steps of a feature are averaged over the
tasks in proportion to how often they saw it, in slices on the executors. A task's steps have a fixed
size, so the input is read by at most a task per ``TASK_TOKENS`` training tokens, however many files or
partitions it comes in, and what is shuffled grows with the texts. Texts are scored in sparse numpy batches. The counts of the ``TOP_WORDS`` most frequent words go to every task (a table of fixed
size); those of all other words are joined by a shuffle. Words are told apart by 64-bit hashes.

Defined results: a null or empty text is its end token alone; without training texts the base takes
N and V as 0 and the model is uniform over classes; repeated rows are learned from as often as they
come and scored one by one; a null id is learned from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.text import hash_words, lower, mix, pieces, utf8, word_spans
from kindred.session import cut_lineage

OWN_CLASSES, SPELLED_CLASSES = 31, 32
END_CLASS = OWN_CLASSES
CLASSES = OWN_CLASSES + 1 + SPELLED_CLASSES
SPELLING_BITS, FEATURE_BITS, TABLE_BITS = 14, 15, 22
TOP_WORDS = 1 << 18
FEATURES = 6
ROUNDS, STEP_TOKENS, RATE = 3, 2048, 0.5
SLICES = 16
GROUP_PARTITIONS = 128
FRESH_WORDS = 500_000  # distinct words of pieces that wait to be combined with those before
TASK_TOKENS = 2_000_000  # training tokens of a task that sends sums; 667,000 a round
_U = np.uint64
_KEY = np.min_scalar_type((1 << FEATURE_BITS) - 1)  # two bytes: numpy sorts these by counting
_START, _END = _U(0x51ED270B7F4A7C15), _U(0x2545F4914F6CDD1D)


def batch_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per piece of a column: range, word hashes, spelling numbers, and each text's first word."""
    data, offsets = utf8(column)
    for lo, hi in pieces(offsets):
        raw = lower(data[offsets[lo] : offsets[hi]])
        starts, ends, first = word_spans(raw, offsets[lo : hi + 1] - offsets[lo])
        spelled = np.zeros(len(starts), dtype=np.uint64)
        padded = np.concatenate([np.zeros(4, np.uint8), raw, np.zeros(1, np.uint8)])
        size = ends - starts
        for k in range(2):
            spelled = spelled << _U(8) | padded.take(starts + (4 + k)) * (size > k)
        for k in range(1, 5):
            spelled = spelled << _U(8) | padded.take(ends + (4 - k)) * (size >= k)
        yield lo, hi, hash_words(raw, starts, ends), (mix(spelled + _U(1)) >> _U(64 - SPELLING_BITS)).astype(np.int64), first


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of a task's texts, combined before they leave the task."""
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, fresh = [nothing], 0

    def combined(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, spelled, counts = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.argsort(words)
        words = words[order]
        opens = np.ones(len(words), dtype=bool)
        opens[1:] = words[1:] != words[:-1]
        at = np.flatnonzero(opens)
        return words[at], spelled[order[at]], np.add.reduceat(counts[order], at) if len(at) else counts

    def out(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[0].view(np.int64)), pa.array(rows[1].astype(np.int32)), pa.array(rows[2])], ["word", "spelling", "c"])

    for batch in batches:
        for _, _, words, spelled, _ in batch_words(batch.column(0)):
            held.append(combined([(words, spelled, np.ones(len(words), np.int64))]))
            fresh += len(held[-1][0])
            if fresh > FRESH_WORDS:
                held, fresh = [combined(held)], 0
                if len(held[0][0]) > 1_500_000:
                    yield out(held[0])
                    held = [nothing]
    rows = combined(held)
    for lo in range(0, len(rows[0]), 200_000):
        yield out(tuple(x[lo : lo + 200_000] for x in rows))


@dataclass
class Vocabulary:
    """What every task knows of the words: a table of fixed size."""

    words: np.ndarray  # hashes, most frequent first
    counts: np.ndarray
    table: np.ndarray = field(init=False)

    def __getstate__(self) -> tuple[np.ndarray, np.ndarray]:
        return self.words, self.counts  # the table, the largest part, is made anew where it is used

    def __setstate__(self, state: tuple[np.ndarray, np.ndarray]) -> None:
        self.words, self.counts = state
        self.__post_init__()

    def __post_init__(self) -> None:
        self.table = np.full(1 << TABLE_BITS, -1, dtype=np.int32)
        order = np.arange(len(self.words))[::-1]
        self.table[self.words[order] >> _U(64 - TABLE_BITS)] = order  # of two words in one place the more frequent stays

    def find(self, words: np.ndarray) -> np.ndarray:
        """The rank of each word, -1 for words that are not in the table."""
        if not len(self.words):
            return np.full(len(words), -1, dtype=np.int32)
        at = self.table[words >> _U(64 - TABLE_BITS)]
        return np.where((at >= 0) & (self.words[at] == words), at, -1)


@dataclass
class Model:
    vocabulary: Vocabulary
    class_of: np.ndarray  # by spelling
    weights: np.ndarray  # features x classes
    log_total: np.ndarray  # log10 of N(class) + 0.5 (V(class) + 1); 0 for classes of one token


def _stream(words: np.ndarray, rank: np.ndarray, spelled: np.ndarray, first: np.ndarray, class_of: np.ndarray | None):
    """Texts as one stream of tokens with their ends: classes, features, owners, and whether an end.

    Without ``class_of`` the spellings and last frequent words alone.
    """
    texts = len(first) - 1
    n = len(words) + texts
    ends = first[1:] + np.arange(texts)
    begins = first[:-1] + np.arange(texts)
    is_end = np.zeros(n, dtype=bool)
    is_end[ends] = True
    is_word = ~is_end
    own = np.full(n, END_CLASS, dtype=np.int64)
    own[is_word] = np.where((rank >= 0) & (rank < OWN_CLASSES), rank, -1)
    lengths = np.diff(first) + 1
    begin = np.repeat(begins, lengths)  # of the text of each token
    # the last word with a class of its own before each token, OWN_CLASSES + 1 for none
    before = np.full(n, -1)
    np.maximum.accumulate(np.where((own >= 0) & is_word, np.arange(n), -1)[:-1], out=before[1:])
    last = np.where(before >= begin, own[before], OWN_CLASSES + 1)
    spelling = np.zeros(n, dtype=np.int64)
    spelling[is_word] = spelled
    if class_of is None:
        return spelling[own < 0], last[own < 0]
    classes = np.where(own >= 0, own, class_of[spelling])
    token = np.full(n + 3, _START)  # three places before the first text
    token[3:][is_word] = words
    token[3:][is_end] = _END
    back = [token[3 - k : n + 3 - k].copy() for k in (1, 2, 3)]
    for j in range(3):  # token j of a text has j tokens before it
        at = begins[lengths > j] + j
        for k in range(j, 3):
            back[k][at] = _START
    features = np.empty((n, FEATURES), dtype=np.int32)

    def feature(keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> _U(64 - FEATURE_BITS)).astype(np.int32)

    features[:, 0] = feature(back[0] * _U(0x9E3779B97F4A7C15) + _U(1))
    features[:, 1] = feature(back[1] * _U(0xBF58476D1CE4E5B9) + _U(2))
    features[:, 2] = feature(back[2] * _U(0x94D049BB133111EB) + _U(3))
    features[:, 3] = feature(back[0] * _U(0xD6E8FEB86659FD93) + back[1] * _U(0xA0761D6478BD642F) + _U(4))
    features[:, 4] = feature(np.arange(OWN_CLASSES + 2, dtype=np.uint64) + _U(5 << 32))[last]
    features[:, 5] = feature(np.full(1, 6 << 32, dtype=np.uint64))
    owner = np.repeat(np.arange(texts), lengths)
    return classes, features, owner, is_end


def _highest(rows: np.ndarray) -> np.ndarray:
    """The largest value of each row as a column, found by halves of columns: a reduction of short rows is slow."""
    while rows.shape[1] > 8 and rows.shape[1] % 2 == 0:
        half = rows.shape[1] // 2
        rows = np.maximum(rows[:, :half], rows[:, half:])
    return np.ascontiguousarray(rows.T).max(axis=0)[:, None]


def _shifted_logits(weights: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits less the largest of their row, and the logarithm of the sum of their exponentials."""
    at = np.ascontiguousarray(features.T, dtype=np.intp)
    logits = weights.take(at[0], axis=0)
    more = np.empty_like(logits)
    for k in range(1, len(at)):
        logits += weights.take(at[k], axis=0, out=more, mode="clip")
    logits -= _highest(logits)
    return logits, np.log(np.exp(logits, out=more).sum(axis=1, keepdims=True))


def _log_softmax(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    logits, log_sum = _shifted_logits(weights, features)
    logits -= log_sum
    return logits


def _log_chance(weights: np.ndarray, features: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """``_log_softmax`` at one class per row."""
    logits, log_sum = _shifted_logits(weights, features)
    return logits[np.arange(len(logits)), classes] - log_sum[:, 0]


def _sliced_sum(parts: DataFrame, dtype: str) -> dict[int, np.ndarray]:
    """Sums of the blobs of each slice, added up on the executors; one blob per slice comes back.

    From ``GROUP_PARTITIONS`` shuffle partitions on, a setting that follows the data, the blobs of a slice meet in
    groups of tasks first, so no task reads those of all tasks.
    """

    def adder(kind: str) -> Callable:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for at, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    values = np.frombuffer(blob.as_buffer(), kind)
                    if at in total:
                        total[at] += values
                    else:
                        total[at] = values.astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "blob"])

        return add

    schema = "slice int, blob binary"
    groups = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // GROUP_PARTITIONS
    if groups > 1:
        dealt = parts.withColumn("group", F.spark_partition_id() % groups).repartition(SLICES * groups, "slice", "group")
        parts, dtype = dealt.select("slice", "blob").mapInArrow(adder(dtype), schema), "<f8"
    rows = parts.repartition(SLICES, "slice").mapInArrow(adder(dtype), schema).collect()
    return {r.slice: np.frombuffer(r.blob, np.float64) for r in rows}


def _most_frequent(vocabulary: DataFrame, most: int) -> pd.DataFrame:
    """The ``most`` words with the highest counts, ties by word: (word, c), highest first.

    Nothing is sorted as a whole: counts are counted by size, then exactly in the size in which the cut falls, and words
    with the count at the cut by their first bits, so only the rows that are wanted come to the driver.
    """

    def cut(rows: DataFrame, key: Column, falling: bool, room: int) -> tuple[int | None, int]:
        """The value of ``key`` at which ``room`` rows are full, and how many rows come before that value."""
        found = sorted(((r["k"], r["count"]) for r in rows.groupBy(key.alias("k")).count().collect()), reverse=falling)
        before = 0
        for k, n in found:
            if before + n > room:
                return k, before
            before += n
        return None, before

    size = F.floor(F.log2("c") * 8)  # some 400 sizes at most
    at, before = cut(vocabulary, size, True, most)
    wanted = F.lit(True)
    if at is not None:
        inside = vocabulary.where(size == at)
        count, more = cut(inside, F.col("c"), True, most - before)
        room = most - before - more
        tied = inside.where(F.col("c") == count)
        part, fewer = cut(tied, F.shiftright("word", 48), False, room)
        edge = sorted(r["word"] for r in tied.where(F.shiftright("word", 48) == part).select("word").collect())[: room - fewer]
        last = edge[-1] if edge else None
        tie = F.shiftright("word", 48) < part
        wanted = (F.col("c") > count) | ((F.col("c") == count) & (tie if last is None else tie | (F.col("word") <= last)))
    top = vocabulary.where(wanted).select("word", "c").toPandas()
    return top.sort_values(["c", "word"], ascending=[False, True], ignore_index=True)


def _few_tasks(texts: DataFrame, tokens: int) -> DataFrame:
    """All of ``texts``, read by at most a task per ``TASK_TOKENS`` of their ``tokens``; nothing is shuffled for it."""
    return texts.coalesce(max(1, -(-tokens // TASK_TOKENS)))


def _blob_rows(blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], ["slice", "blob"])


def _spelling_classes(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """A class for every spelling: clusters of the frequent words it follows, over all training texts."""
    width = OWN_CLASSES + 2
    known = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width << SPELLING_BITS, dtype=np.int64)
        for batch in batches:
            for _, _, words, spelled, first in batch_words(batch.column(0)):
                spelling, last = _stream(words, known.value.find(words), spelled, first, None)
                counts += np.bincount(spelling * width + last, minlength=len(counts))
        yield _blob_rows([x.astype("<u4").tobytes() for x in np.split(counts, SLICES)])

    found = _sliced_sum(texts.mapInArrow(follow, "slice int, blob binary"), "<u4")
    known.destroy()
    if not found:
        return np.full(1 << SPELLING_BITS, END_CLASS + 1)
    counts = np.concatenate([found[k] for k in range(SLICES)]).reshape(-1, width)
    # clusters of the square roots of smoothed shares, weighted by frequency
    mean = counts.sum(axis=0) + 1.0
    shares = (counts + 5 * mean / mean.sum()) / (counts.sum(axis=1, keepdims=True) + 5)
    points, mass = np.sqrt(shares), counts.sum(axis=1)
    rng = np.random.default_rng(5)
    centres = points[[int(np.argmax(mass))]]
    while len(centres) < SPELLED_CLASSES:
        gap = np.min(2 - 2 * points @ centres.T, axis=1).clip(0) * mass
        pick = rng.choice(len(points), p=gap / gap.sum()) if gap.sum() > 0 else int(rng.integers(len(points)))
        centres = np.concatenate([centres, points[[pick]]])
    for _ in range(20):
        nearest = np.argmax(points @ centres.T, axis=1)
        for k in range(SPELLED_CLASSES):
            own = nearest == k
            if mass[own].sum() > 0:
                centre = (points[own] * mass[own, None]).sum(axis=0)
                centres[k] = centre / np.linalg.norm(centre)
    return END_CLASS + 1 + np.argmax(points @ centres.T, axis=1)


def _sums_by(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``keys`` and the sums of their ``rows``."""
    order = np.argsort(keys.astype(_KEY), kind="stable")
    sorted_ = keys[order]
    at = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    counts = np.diff(np.append(at, len(keys)))
    total = rows.take(order[at], axis=0)
    twice = np.flatnonzero(counts == 2)  # half of the keys that come again
    if len(twice):
        total[twice] += rows.take(order[at[twice] + 1], axis=0)
    several = counts > 2
    if several.any():
        own = counts[several]
        total[several] = np.add.reduceat(rows.take(order[np.repeat(several, counts)], axis=0), np.cumsum(own) - own, axis=0)
    return sorted_[at], total


def _weighted_steps(before: np.ndarray, after: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """A task's steps times how often it saw each feature, and how often."""
    return np.concatenate([(after - before) * seen[:, None], seen[:, None]], axis=1).astype("<f4")


def _train(texts: DataFrame, model: Model) -> None:
    """One round of distributed gradient steps over ``texts``; changes the model's weights."""
    known = texts.sparkSession.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        weights = m.weights.copy()
        squares = np.full(len(weights), 1e-3, dtype=np.float32)  # one step length per feature
        seen = np.zeros(len(weights), dtype=np.int64)
        for batch in batches:
            for _, _, words, spelled, first in batch_words(batch.column(0)):
                classes, features, _, _ = _stream(words, m.vocabulary.find(words), spelled, first, m.class_of)
                seen += np.bincount(features.ravel(), minlength=len(seen))
                for lo in range(0, len(classes), STEP_TOKENS):
                    own, target = features[lo : lo + STEP_TOKENS], classes[lo : lo + STEP_TOKENS]
                    slope = _log_softmax(weights, own)
                    np.exp(slope, out=slope)
                    slope[np.arange(len(target)), target] -= 1
                    slope /= FEATURES
                    for k in range(FEATURES):
                        rows, total = _sums_by(own[:, k], slope)
                        length = squares.take(rows) + np.einsum("ij,ij->i", total, total)
                        squares[rows] = length
                        total *= (RATE / np.sqrt(length))[:, None]
                        weights[rows] = weights.take(rows, axis=0) - total
        yield _blob_rows([x.tobytes() for x in np.split(_weighted_steps(m.weights, weights, seen), SLICES)])

    found = _sliced_sum(texts.mapInArrow(learn, "slice int, blob binary"), "<f4")
    known.destroy()
    if found:
        both = np.concatenate([found[k] for k in range(SLICES)]).reshape(-1, CLASSES + 1)
        model.weights = (model.weights + both[:, :-1] / np.maximum(both[:, -1:], 1)).astype(np.float32)


PARTIAL = "doc long, doc_id long, n_tokens long, known long, base double, score double, word long, tf long"


def _partial_scores(rows: DataFrame, model: Model, end_count: int) -> DataFrame:
    """Per text what its task can tell, and a row per word whose count it does not know."""
    known = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        log_counts = np.log10(m.vocabulary.counts + 0.5)
        for batch in batches:
            docs, ids = batch.column(0).to_numpy(), batch.column(1)
            for lo, hi, words, spelled, first in batch_words(batch.column(2)):
                texts = hi - lo
                rank = m.vocabulary.find(words)
                classes, features, owner, is_end = _stream(words, rank, spelled, first, m.class_of)
                chance = np.empty(len(classes))
                for at in range(0, len(classes), STEP_TOKENS):
                    part = slice(at, at + STEP_TOKENS)
                    chance[part] = _log_chance(m.weights, features[part], classes[part])
                chance = chance / np.log(10) - m.log_total[classes]
                own = np.repeat(np.arange(texts), np.diff(first))
                there = rank >= 0
                counted = np.zeros(len(words))
                counted[there] = log_counts[rank[there]]
                base = np.bincount(own, weights=counted, minlength=texts) + np.log10(end_count + 0.5)
                # a word of a class of its own is certain within it
                inside = np.where(classes[~is_end] < OWN_CLASSES, 0.0, counted)
                score = np.bincount(owner, weights=chance, minlength=texts) + np.bincount(own, weights=inside, minlength=texts)
                known_words = np.bincount(own[there], minlength=texts) + (end_count > 0)
                rare_own, rare_words = own[~there], words[~there]
                order = np.lexsort((rare_words, rare_own))
                rare_own, rare_words = rare_own[order], rare_words[order]
                opens = np.ones(len(order), dtype=bool)
                opens[1:] = (rare_own[1:] != rare_own[:-1]) | (rare_words[1:] != rare_words[:-1])
                begin = np.flatnonzero(opens)
                tf = np.diff(np.append(begin, len(order)))
                at, rare = rare_own[begin] + lo, rare_words[begin]
                none = pa.nulls
                r = len(rare)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[lo:hi]), ids.slice(lo, texts), pa.array(np.diff(first) + 1), pa.array(known_words.astype(np.int64)), pa.array(base), pa.array(score), none(texts, pa.int64()), none(texts, pa.int64())],
                    NAMES,
                )
                for k in range(0, r, 100_000):
                    m_ = min(100_000, r - k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[at[k : k + m_]]), none(m_, pa.int64()), none(m_, pa.int64()), none(m_, pa.int64()), none(m_, pa.float64()), none(m_, pa.float64()), pa.array(rare[k : k + m_].view(np.int64)), pa.array(tf[k : k + m_])],
                        NAMES,
                    )

    return rows.select("doc", "doc_id", "text").mapInArrow(run, PARTIAL)


NAMES = [c.split()[0] for c in PARTIAL.split(", ")]


def score_texts(docs: DataFrame, learns: Callable[[Column], Column]) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_tokens, n_known, train_tokens, base_score and score.

    ``learns`` tells from the id whether a text is learned from.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    training = source.where(learns(F.col("doc_id")))
    counted = training.select("text").mapInArrow(_count_words, "word long, spelling int, c long")
    vocabulary = cut_lineage(counted.groupBy("word").agg(F.sum("c").alias("c"), F.first("spelling").alias("spelling")))
    totals = vocabulary.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = training.count()
    n, v = (totals.n or 0) + ends, totals.v + (ends > 0)
    top = _most_frequent(vocabulary, TOP_WORDS)
    words = Vocabulary(top["word"].to_numpy().astype(np.int64).view(np.uint64), top["c"].to_numpy().astype(np.int64))
    class_of = _spelling_classes(_few_tasks(training.select("text"), n), words)
    by_spelling = vocabulary.groupBy("spelling").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()  # at most 2**14 rows
    first = words.words[:OWN_CLASSES]
    first = first[words.find(first) >= 0]  # a word displaced from the table is counted with its spelling
    own = vocabulary.where(F.col("word").isin(first.view(np.int64).tolist())).select("spelling", "c").collect()
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for rows, sign in ((by_spelling, 1), ([(r.spelling, r.c, 1) for r in own], -1)):
        for spelling, c, kinds in rows:
            class_n[class_of[spelling]] += sign * c
            class_v[class_of[spelling]] += sign * kinds
    log_total = np.log10(class_n + 0.5 * (class_v + 1))
    log_total[: END_CLASS + 1] = 0.0
    model = Model(words, class_of, np.zeros((1 << FEATURE_BITS, CLASSES), dtype=np.float32), log_total)
    for turn in range(ROUNDS):
        part = training.where(F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(ROUNDS)), F.lit(0)) == turn)
        _train(_few_tasks(part.select("text"), n), model)
    numbered = source.withColumn("doc", F.monotonically_increasing_id())
    partial = cut_lineage(_partial_scores(numbered, model, ends))
    rare = partial.where("word is not null").select("doc", "word", "tf")
    log_c = F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(0.5)) * F.col("tf")
    more = (
        rare.join(vocabulary.select("word", "c"), "word", "left")
        .groupBy("doc")
        .agg(F.sum(log_c).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more_known"))
    )
    tokens = F.col("n_tokens")
    return (
        partial.where("word is null")
        .join(more, "doc", "left")
        .select(
            "doc_id", "n_tokens",
            (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more", F.lit(0.0)) - tokens * float(np.log10(n + 0.5 * (v + 1)))).alias("base_score"),
            (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
        )
    )
