import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from kindred.functions import cleaning as c
from kindred.functions import strings as s
from kindred.functions.ngrams import char_ngrams
from kindred.functions.vectors import cosine


def plain_jaro_winkler(a, b):
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits = [False] * len(b), []
    for k, ch in enumerate(a):
        for q in range(max(0, k - reach), min(len(b), k + reach + 1)):
            if not used[q] and b[q] == ch:
                used[q] = True
                hits.append(ch)
                break
    m = len(hits)
    if not m:
        return 0.0
    other = [ch for ch, u in zip(b, used) if u]
    t = sum(x != y for x, y in zip(hits, other)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcé ", max_size=14), st.text(alphabet="abcé ", max_size=14))
def test_jaro_winkler_is_the_plain_one_and_below_its_bound(a, b):
    texts = s.Encoded([a, b])
    i, j = np.array([0]), np.array([1])
    got = texts.jaro_winkler(i, j)[0]
    assert got == pytest.approx(plain_jaro_winkler(a, b), abs=1e-12)
    assert texts.jaro_winkler(j, i)[0] == pytest.approx(got, abs=1e-12)
    assert texts.jaro_winkler_bound(i, j)[0] >= got
    assert texts.ratio_bound(i, j)[0] >= SequenceMatcher(None, a, b).ratio()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abc é", max_size=16), min_size=2, max_size=8))
def test_matching_blocks_are_the_plain_ones(words):
    texts = s.Encoded(words)
    i, j = (x.ravel() for x in np.meshgrid(range(len(words)), range(len(words))))
    assert texts.ratio(i, j).tolist() == [SequenceMatcher(None, words[p], words[q]).ratio() for p, q in zip(i, j)]


def test_matching_blocks_of_long_texts(monkeypatch):
    """From 200 characters on, frequent characters begin no block; steps of any size give the same."""
    rng = random.Random(8)
    words = ["".join(rng.choice("aab cdefghijklmnopqrstuvwxyz0123456789" * 2 + "ABCDEFG") for _ in range(n)) for n in (0, 1, 30, 199, 200, 201, 350, 500)]
    for k in (3, 5, 6, 7):  # edited copies
        text = list(words[k])
        for _ in range(25):
            text[rng.randrange(len(text))] = rng.choice("abxyz ")
        words.append("".join(text[:60] + text[90:]))
    words += ["ab" * 150, "ba" * 120, "x" * 400, "x" * 210 + "yz" * 9 + "x" * 40]
    texts = s.Encoded(words)
    i, j = (x.ravel() for x in np.meshgrid(range(len(words)), range(len(words))))
    want = [SequenceMatcher(None, words[p], words[q]).ratio() for p, q in zip(i, j)]
    assert texts.ratio(i, j).tolist() == want
    monkeypatch.setattr(s, "_STEP_CELLS", 700)
    assert texts.ratio(i, j).tolist() == want


def test_one_long_text_does_not_widen_the_others():
    import tracemalloc

    words = ["short name %d" % k for k in range(1000)] + ["long" * 12_500]
    tracemalloc.start()
    texts = s.Encoded(words)
    texts.common_bound(np.arange(1000), np.full(1000, 1000))
    texts.jaro_winkler(np.arange(1000), np.arange(1000)[::-1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20


def test_jaro_winkler_of_many_lengths_at_once():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.choice([0, 1, 2, 5, 9, 40, 90]))) for _ in range(60)]
    texts = s.Encoded(words)
    i, j = (x.ravel() for x in np.meshgrid(range(60), range(60)))
    want = [plain_jaro_winkler(words[p], words[q]) for p, q in zip(i, j)]
    assert np.allclose(texts.jaro_winkler(i, j), want)


def test_string_columns(spark):
    rows = [("tide", "diet"), ("diet", "tide"), (None, "x"), ("", ""), ("über", "uber")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(
        s.jaro_winkler("a", "b"), s.sequence_ratio("a", "b"), s.fuzzy_ratio("a", "b"), s.exact("a", "b")
    ).collect()
    assert got[0][1] == 0.25 and got[1][1] == 0.5  # orientation matters
    assert tuple(got[2]) == (0.0, 0.0, 0, 0)
    assert tuple(got[3]) == (0.0, 1.0, 100, 1)
    assert got[4][0] == pytest.approx(0.8333333, abs=1e-6)  # by characters, not bytes
    assert [r[2] for r in got[:2]] == [25, 50]


def test_both_empty(spark):
    df = spark.createDataFrame([("", ""), ("a", "")], "a string, b string")
    got = df.select(s.both_empty_zero(F.col("a"), F.col("b"), F.lit(0.5))).collect()
    assert [r[0] for r in got] == [0.0, 0.5]


def test_levenshtein(spark):
    df = spark.createDataFrame([("", ""), ("abc", "abd"), (None, "a")], "a string, b string")
    got = [r[0] for r in df.select(s.levenshtein_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and got[1] == pytest.approx(2 / 3) and got[2] is None


def test_null_policies_and_normalisation(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "\t Société, S.A.\n"), (4, " \n")], "k int, name string")
    one = lambda e: [r[0] for r in df.orderBy("k").select(e).collect()]
    assert one(c.normalize_name("name")) == ["nan", "", "société, s.a.", ""]
    assert one(c.normalize_company_name("name")) == ["", "", "société sa", ""]
    assert one(c.match_text("name", "k")) == ["nan|1", "|2", "\t Société, S.A.\n|3", " \n|4"]
    assert one(c.first_filled("name")) == ["UNKNOWN", "UNKNOWN", "\t Société, S.A.\n", " \n"]
    assert one(c.first_letter("name"))[:2] == [None, None]
    assert [r.k for r in c.drop_blank(df, "name").collect()] == [3]
    assert [r.k for r in c.drop_null_key(df, "name").orderBy("k").collect()] == [2, 3, 4]
    filled = c.fill_empty(df, ["name", "k"]).orderBy("k").first()
    assert (filled.name, filled.k) == ("", "1")
    assert c.strip_lower(df).filter("k = 3").first().name == "société, s.a."


def test_lists(spark):
    rows = [Row(x=["a", "it's"], t="['a', \"it's\"]"), Row(x=None, t="nan"), Row(x=[], t="plain"), Row(x=["b"], t=None)]
    df = spark.createDataFrame(rows, "x array<string>, t string")
    got = df.select(
        c.join_list("x"), c.quote_list("x"), c.parse_list_literal("t"), c.list_literal("x"), c.split_list("t", ".")
    ).collect()
    assert tuple(got[0])[:4] == ("a; it's", "'a'|'it's'", ["a", "it's"], "['a', \"it's\"]")
    assert tuple(got[1]) == ("", "Unknown", None, None, ["nan"])
    assert tuple(got[2])[:4] == ("", "", ["plain"], "[]")
    assert got[3][2] is None and got[3][4] is None


def test_pair_key_and_label_first(spark):
    df = spark.createDataFrame([("b", "a", 1), ("a", "b", None)], "l string, r string, label int")
    keys = df.select(*c.pair_key("l", "r")).distinct().collect()
    assert [tuple(k) for k in keys] == [("a", "b")]
    out = c.label_first(df)
    assert out.columns == ["label", "l", "r"] and out.count() == 1


def test_ngrams_and_cosine(spark):
    df = spark.createDataFrame([("abcd",), ("a",), ("",), ("é😀x",)], "t string")
    assert [r[0] for r in df.select(char_ngrams("t", 2)).collect()] == [["ab", "bc", "cd"], [], [], ["é😀", "😀x"]]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in v.select(cosine("a", "b")).collect()]
    assert got[0] == pytest.approx(2**-0.5) and got[1] is None
