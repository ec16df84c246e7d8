import itertools

import pytest
from pyspark.sql import functions as F

from kindred.functions.cleaning import first_letter
from kindred.operators import blocking as b
from kindred.operators import matching as mt
from kindred.operators import tfidf
from kindred.operators.components import connected_components
from kindred.operators.tfidf import canopies, similar_texts, weights
from tests.test_functions import plain_jaro_winkler as jw

NAMES = ["acme corp", "acme corp.", "acme co", "acmi corp", "zeta ltd", "zeta limited", "omega", "omege", "ab", "a", ""]


@pytest.fixture(scope="module")
def records():
    out = []
    for k in range(90):
        out.append((k, NAMES[(k * 7) % len(NAMES)], ["bank", "oil", None][k % 3], ["rome", "", "pisa", "oslo"][k % 4]))
    return out


@pytest.fixture(scope="module")
def frame(spark, records):
    return spark.createDataFrame(records, "rec_id long, name string, industry string, city string")


def test_link_records_equals_brute_force(frame, records):
    rule = mt.band_or_exact("name", "industry", "city")
    cols = ["name", "industry", "city"]
    indexers = [b.Block("industry"), b.Block("city"), b.Neighbourhood("name", 3)]
    found = mt.link_records(frame, cols, indexers, rule, "name", tile_rows=3).collect()
    order = {n: k for k, n in enumerate(sorted({r[1] for r in records}))}
    want = set()
    for x, y in itertools.combinations(records, 2):
        paired = (x[2] and x[2] == y[2]) or (x[3] and x[3] == y[3]) or abs(order[x[1]] - order[y[1]]) <= 1
        same = x[2] is not None and x[2] == y[2] and x[3] == y[3]
        sim = round(jw(x[1], y[1]), 9)
        if paired and x[1] != y[1] and (0.8 < sim < 0.92 or (sim > 0.9 and same)):
            want.add((x[0], y[0]))
    assert {(r.id_left, r.id_right) for r in found} == want and len(found) == len(want)
    by_id = {r[0]: r for r in records}
    for r in found:
        assert (r.name_left, r.city_left, r.name_right) == (by_id[r.id_left][1], by_id[r.id_left][3], by_id[r.id_right][1])


def test_copies_are_compared_once(frame):
    shapes = mt.profiles(frame, ["name", "industry"])
    assert shapes.count() < 40
    assert shapes.agg(F.sum("n_records")).first()[0] == 90


def test_rule_bounds_are_strict(spark):
    rows = [(0.80, 0, 0), (0.92, 0, 0), (0.85, 0, 0), (0.92, 1, 1), (0.9, 1, 1), (0.95, 1, 0)]
    df = spark.createDataFrame(rows, "name_sim double, industry_exact int, city_exact int")
    kept = df.filter(mt.band_or_exact("name", "industry", "city").condition()).collect()
    assert [tuple(r) for r in kept] == [(0.85, 0, 0), (0.92, 1, 1), (0.9, 1, 1)]
    k = mt.mandatory_and_k_of_n(["name", "city", "x"], {"name": 0.7, "city": 0.75})
    rows = [(0.71, 0.76, 0.75), (0.71, 0.76, 0.74), (0.7, 0.9, 0.9), (0.9, 0.75, 0.9)]
    df = spark.createDataFrame(rows, "name_similarity double, city_similarity double, x_similarity double")
    assert [tuple(r) for r in df.filter(k.condition()).collect()] == [rows[0]]
    w = mt.weighted_with_floor({"name": "n", "city": "c"})
    assert set(w.measures) == {"name_sim", "city_sim"}


def test_not_identical_keeps_missing(spark):
    df = spark.createDataFrame([("a", "a"), ("a", None), (None, None), ("a", "b")], "l string, r string")
    assert df.filter(mt.not_identical(F.col("l"), F.col("r"))).count() == 3


def plain_tfidf(texts):
    import math
    from collections import Counter

    grams = [Counter(t[k : k + 2] for k in range(len(t) - 1)) for t in texts]
    df = Counter(g for c in grams for g in c)
    out = []
    for c in grams:
        w = {g: n * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in c.items()}
        size = math.sqrt(sum(v * v for v in w.values()))
        out.append({g: v / size for g, v in w.items()})
    return out


def dot(a, b):
    return sum(v * b.get(g, 0.0) for g, v in a.items())


def test_tfidf_pairs_equal_brute_force(frame, records):
    vectors = plain_tfidf([r[1] for r in records])
    names = mt.profiles(frame, ["name"])
    first = {}
    for r in records:
        first.setdefault(r[1], r[0])
    for threshold in (0.3, 0.5, 0.9):
        got = similar_texts(names, "name", threshold, copies="n_records", tile_rows=2).collect()
        want = {}
        for (n, i), (m, j) in itertools.combinations(sorted(first.items(), key=lambda x: x[1]), 2):
            value = dot(vectors[i], vectors[j])
            if value >= threshold:
                want[(i, j)] = pytest.approx(value, abs=1e-6)
        assert {(r.id_left, r.id_right): r.cosine for r in got} == want
    one = weights(names, "name", copies="n_records").groupBy("rec_id").agg(F.sum(F.col("weight") ** 2).alias("s"))
    assert all(r.s == pytest.approx(1.0) for r in one.collect())


@pytest.mark.parametrize("local", [100_000, 5])
def test_canopies_of_a_chain(spark, monkeypatch, local):
    """Every other row of a chain is a centre, however long the chain is."""
    n = 1000 if local > 5 else 24
    edges = spark.createDataFrame([(k, k + 1, 0.9) for k in range(n)], "id_left long, id_right long, cosine double")
    monkeypatch.setattr(tfidf, "similar_texts", lambda *a, **k: edges)
    got = canopies(spark.range(n + 1).selectExpr("id as rec_id", "'x' as name"), "name", local_edges=local).collect()
    assert {r.canopy for r in got} == set(range(0, n + 1, 2)) and len(got) == n // 2 + 1 + n


def test_components(spark):
    chain = [(k, k + 1) for k in range(300)] + [(1000 + k, 2000) for k in range(50)] + [(7000, 7000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[k] for k in range(301)} == {0} and got[2000] == 1000 and len(got) == 301 + 51
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("local", [0, 3, 10**6])
def test_components_in_rounds_and_in_one_task(spark, monkeypatch, local):
    """The same labels whether a task finishes the rest or rounds go on to the end, and with many small forests."""
    import random

    from kindred.operators import components

    monkeypatch.setattr(components, "FOREST_NODES", 20)
    rng = random.Random(local)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(500 + k, 501 + k) for k in range(40)] + [(9, 9), (700, 700)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    got = [(r.node, r.component) for r in connected_components(df, local).collect()]
    assert sorted(got) == sorted((x, root(x)) for x in up)
    named = df.selectExpr("concat('n', 1000 + a) AS a", "concat('n', 1000 + b) AS b")
    assert sorted((r.node, r.component) for r in connected_components(named, local).collect()) == sorted((f"n{1000 + x}", f"n{1000 + root(x)}") for x in up)


@pytest.mark.parametrize("local", [100_000, 4])
@pytest.mark.parametrize("loose,tight", [(0.5, 0.3), (0.3, 0.7)])
def test_canopies_equal_one_by_one(spark, loose, tight, local):
    import random

    rng = random.Random(2)
    texts = sorted({"".join(rng.choice("ab c") for _ in range(rng.randint(1, 7))).strip() for _ in range(70)})
    df = spark.createDataFrame(list(enumerate(texts)), "rec_id long, name string")
    vectors = plain_tfidf(texts) if all(len(t) > 1 for t in texts) else None
    if vectors is None:
        keep = [t for t in texts if len(t) > 1]
        short = [t for t in texts if len(t) <= 1]
        texts = keep
        df = spark.createDataFrame(list(enumerate(keep)), "rec_id long, name string")
        vectors = plain_tfidf(keep)
        assert short is not None
    assigned, want = set(), set()
    for i in range(len(texts)):
        if i in assigned:
            continue
        want.add((i, i))
        for j in range(len(texts)):
            value = round(dot(vectors[i], vectors[j]), 9)
            if i != j and value >= loose:
                want.add((i, j))
                if value >= tight:
                    assigned.add(j)
    got = canopies(df, "name", loose=loose, tight=tight, local_edges=local).collect()
    assert {(r.canopy, r.rec_id) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("loose,tight", [(0.5, 0.3), (0.3, 0.7)])
def test_canopies_by_batch_are_those_of_all_pairs(spark, monkeypatch, loose, tight):
    """Centres found a few rows at a time, hot blocks cut into tiles, repeated and missing ids and short texts; pairs of two
    rows that others take are not made."""
    import random

    rng = random.Random(5)
    rows = [(k, "".join(rng.choice("ab c") for _ in range(rng.randint(1, 7))), 1 + k % 3) for k in range(90)]
    rows += [(None, "abab", 1), (None, "x", 1), (rows[-1][0], rows[-1][1], 2), (100, None, 1), (100, None, 1), (101, "zq", 1), (101, "zq", 1)]
    df = spark.createDataFrame(rows, "rec_id long, name string, n long").repartition(3)
    made = []
    between = tfidf._between
    monkeypatch.setattr(tfidf, "_between", lambda *a: made.append(1) or between(*a))
    monkeypatch.setattr(tfidf.pairs_between, "__defaults__", ("block", "rec_id", 3))
    every = lambda size: sorted(
        (str(r.canopy), str(r.rec_id), r.cosine) for r in canopies(df, "name", loose=loose, tight=tight, copies="n", batch_rows=size).collect()
    )
    want = every(1000)
    assert not made and every(10) == want and len(made) > 2


def test_given_blocks_and_first_letter(frame):
    key = frame.select("name").distinct().select("name", first_letter("name").alias("key"))
    given = b.Given(key.filter("key is not null"), "name").members(frame)
    letters = b.FirstLetter("name").members(frame)
    assert given.count() == letters.count()


def test_strategies_at_once_are_the_linkages_one_by_one(frame):
    rule = mt.band_or_similar("name", "city", "city")
    shared = b.Neighbourhood("name", 3)
    sets = {"city": [b.Block("city")], "name": [shared], "both": [b.Block("city"), shared], "letter": [b.FirstLetter("name")]}
    got = mt.link_strategies(frame, ["name", "city"], sets, rule, "name").collect()
    for label, indexers in sets.items():
        want = mt.link_records(frame, ["name", "city"], indexers, rule, "name").collect()
        assert sorted((r.id_left, r.id_right, r.name_sim) for r in got if label in r.strategies) == sorted(
            (r.id_left, r.id_right, r.name_sim) for r in want
        ), label
    assert len({(r.id_left, r.id_right) for r in got}) == len(got) > 0


def test_given_blocks_are_counted(frame):
    key = frame.select("name").distinct().select("name", first_letter("name").alias("key")).dropna()
    got = b.candidate_count(frame, [b.Given(key, "name"), b.Block("city")]).first()[0]
    assert got == b.candidate_count(frame, [b.FirstLetter("name"), b.Block("city")]).first()[0]
    twice = key.unionByName(key.withColumn("key", F.lit("other")))
    with pytest.raises(ValueError, match="several given blocks"):
        b.candidate_count(frame, [b.Given(twice, "name")])


def test_found_pairs_are_not_shuffled(frame):
    """Repeats are told apart, and copies expanded, where a pair is found."""
    rule = mt.band_or_similar("name", "industry", "city")
    found = mt.link_records(frame, ["name", "industry", "city"], [b.Block("industry"), b.Neighbourhood("name", 5)], rule, "name")
    above = found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert "Join" not in above and "Aggregate" not in above


@pytest.mark.parametrize("copies", [1, 2, 256])
def test_copies_in_rows_and_overlapping_blocks(spark, monkeypatch, copies):
    """A pair comes once, whatever blocks it shares and in how many rows the records of a profile are."""
    monkeypatch.setattr(mt, "COPIES_IN_ROW", copies)
    rows = [(k, NAMES[k % 5], ["bank", None][k % 2], None if k % 7 == 0 else "rome") for k in range(60)] + [(None, "acme co", "bank", "rome")]
    df = spark.createDataFrame(rows, "rec_id long, name string, industry string, city string")
    keys = [(n, key) for at, n in enumerate(NAMES[:5]) for key in ("x", "y", "z")[: at + 1]]
    given = b.Given(spark.createDataFrame([*keys, keys[0]], "name string, key string"), "name")
    rule = mt.open_band(["name"], "name", 0.7, 1.0)
    for indexers in ([given], [b.Block("city"), given, b.Neighbourhood("name", 3)]):
        got = mt.link_records(df, ["name", "industry", "city"], indexers, rule, "name", tile_rows=4).collect()
        want = [(x[0], y[0]) for x, y in itertools.combinations(rows[:60], 2) if x[1] != y[1] and 0.7 < round(jw(x[1], y[1]), 9) < 1]
        assert sorted((r.id_left, r.id_right) for r in got) == want
        by = {r[0]: r for r in rows}
        assert all((r.name_left, r.industry_left, r.city_right) == (by[r.id_left][1], by[r.id_left][2], by[r.id_right][3]) for r in got)


def test_counted_candidates_are_not_broadcast(frame):
    sets = [b.Block("industry"), b.Block("city"), b.Neighbourhood("name", 5)]
    assert "Broadcast" not in b.candidate_count(frame, sets)._jdf.queryExecution().executedPlan().toString()
