import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import blocking as b
from kindred.operators import ranking as rk
from kindred.operators.pairjoin import CosineAbove, NameFloors, similar_pairs
from tests.test_functions import plain_jaro_winkler


@pytest.fixture(scope="module")
def words(spark):
    """Names with one that a third of the records share."""
    rng = random.Random(5)
    rows = []
    for k in range(400):
        name = "hot" if k % 3 == 0 else "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
        rows.append((k, name if k % 41 else None, rng.choice(["x", "x", "x", "y", "", None])))
    return rows


@pytest.fixture(scope="module")
def frame(spark, words):
    return spark.createDataFrame(words, "rec_id long, name string, city string").repartition(5)


@pytest.mark.parametrize("ranges", ["1", "4", "90"])
def test_global_row_number(spark, words, frame, ranges):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        keyed = frame.dropna(subset=["name"]).withColumn(
            "key", rk.order_key(F.col("name"), rk.sortable_long("rec_id"))
        )
        got = [(r.rec_id, r["rank"]) for r in rk.global_row_number(keyed, "key").orderBy("rank").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = sorted((w[1], w[0]) for w in words if w[1] is not None)
    assert got == [(rid, k + 1) for k, (_, rid) in enumerate(want)]


def test_ranges_are_even_under_a_hot_key(spark, frame):
    keyed = frame.dropna(subset=["name"]).withColumn("key", rk.order_key(F.col("name"), rk.sortable_long("rec_id")))
    points = rk.split_points(keyed, "key", 4)
    sizes = [r["count"] for r in keyed.groupBy(rk.range_of(F.col("key"), points)).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 200


def test_sortable_long(spark):
    numbers = [-(2**63), -5, 0, 7, 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    keys = [r[0] for r in df.orderBy("n").select(rk.sortable_long("n")).collect()]
    assert keys == sorted(keys)


def test_rank_within_and_row_index(spark, words, frame):
    got = rk.rank_within(frame, "city", rk.sortable_long("rec_id")).collect()
    for city in ("x", "y"):
        mine = sorted((r["rank"], r.rec_id) for r in got if r.city == city)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert [m[1] for m in mine] == sorted(m[1] for m in mine)
    ids = rk.row_index(frame, rk.sortable_long("rec_id")).collect()
    assert all(r.row_id == r.rec_id for r in ids)


def brute(words, on, floor=0.7):
    out = {}
    for (i, n, c), (k, m, d) in itertools.combinations(words, 2):
        if n is None or m is None or n == m or not on((i, n, c), (k, m, d)):
            continue
        value = plain_jaro_winkler(n, m)
        if value > floor:
            out[(i, k)] = value
    return out


@pytest.mark.parametrize("tile_rows", [3, 50, 2048])
def test_similar_pairs_equals_brute_force(frame, words, tile_rows):
    members = b.Block("city").members(frame)
    kernel = NameFloors({"name": 0.7}, differ="name", anchor="anchor")
    found = similar_pairs(members, kernel, tile_rows=tile_rows).collect()
    want = brute(words, lambda p, q: p[2] and p[2] == q[2])
    assert {(r.id_left, r.id_right): pytest.approx(r.name_sim) for r in found} == want
    assert len(found) == len(want)


def test_neighbourhood_blocks_equal_brute_force(frame, words):
    order = {n: k for k, n in enumerate(sorted({w[1] for w in words if w[1] is not None}))}
    for window in (1, 3, 5):
        members = b.Neighbourhood("name", window).members(frame)
        kernel = NameFloors({"name": 0.5}, differ="name", anchor="anchor")
        found = similar_pairs(members, kernel, tile_rows=4).dropDuplicates(["id_left", "id_right"]).collect()
        near = lambda p, q: abs(order[p[1]] - order[q[1]]) <= (window - 1) // 2
        assert {(r.id_left, r.id_right) for r in found} == set(brute(words, near, 0.5))
    with pytest.raises(ValueError):
        b.Neighbourhood("name", 4)


def test_candidate_count_equals_brute_force(frame, words):
    order = {n: k for k, n in enumerate(sorted({w[1] for w in words if w[1] is not None}))}
    near = lambda p, q: p[1] is not None and q[1] is not None and abs(order[p[1]] - order[q[1]]) <= 2
    city = lambda p, q: bool(p[2]) and p[2] == q[2]
    letter = lambda p, q: bool(p[1]) and bool(q[1]) and p[1][0] == q[1][0]
    pairs = list(itertools.combinations(words, 2))
    cases = [
        ([b.Block("city")], lambda p, q: city(p, q)),
        ([b.Neighbourhood("name", 5)], near),
        ([b.Block("city"), b.Neighbourhood("name", 5)], lambda p, q: city(p, q) or near(p, q)),
        (
            [b.Block("city"), b.FirstLetter("name"), b.Neighbourhood("name", 5)],
            lambda p, q: city(p, q) or letter(p, q) or near(p, q),
        ),
    ]
    for indexers, on in cases:
        assert int(b.candidate_count(frame, indexers).first()[0]) == sum(on(p, q) for p, q in pairs)


def test_blank_is_a_key_only_when_asked(frame):
    assert b.Block("city").members(frame).filter("city = ''").count() == 0
    assert b.Block("city", keep_blank=True).members(frame).filter("city = ''").count() > 0


def test_neighbour_values_and_rows(frame, words):
    names = sorted({w[1] for w in words if w[1] is not None})
    count = {n: sum(w[1] == n for w in words) for n in names}
    got = {(r.value_left, r.value_right): int(r.n_pairs) for r in b.neighbour_values(frame, "name", 3).collect()}
    want = {(n, n): count[n] * (count[n] - 1) // 2 for n in names if count[n] > 1}
    want |= {(x, y): count[x] * count[y] for x, y in zip(names, names[1:])}
    assert got == want
    order = [w[0] for w in sorted((w for w in words if w[1] is not None), key=lambda w: (w[1], w[0]))]
    rows = {(r.id_left, r.id_right) for r in b.neighbour_rows(frame, "name", reach=2).collect()}
    assert rows == {tuple(sorted(p)) for d in (1, 2) for p in zip(order, order[d:])}
    beside = b.adjacent_rows(frame, "name").collect()
    assert {(r.rec_id_left, r.rec_id_right) for r in beside} == set(zip(order, order[1:]))


def test_block_sizes(frame, words):
    got = {r.city: (r.n_records, int(r.n_pairs)) for r in b.block_sizes(frame, ["city"]).collect()}
    for city in ("x", "y", ""):
        n = sum(w[2] == city for w in words)
        assert got[city] == (n, n * (n - 1) // 2)
    members = b.exact_blocks(frame, ["city"]).collect()
    assert len(members) == sum(w[2] is not None for w in words)


@pytest.mark.parametrize("keep_best", [None, 7])
def test_cosine_pairs(spark, keep_best):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(120, 6))
    vectors[3] = 0.0  # no direction: no pair
    vectors[50:60] = vectors[10]  # copies
    rows = [(k, "a" if k < 100 else "b", v.tolist()) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "rec_id long, block string, vector array<double>")
    found = similar_pairs(df, CosineAbove(0.5, keep_best=keep_best), tile_rows=16)
    want = []
    with np.errstate(invalid="ignore"):
        unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    for i, j in itertools.combinations(range(120), 2):
        if rows[i][1] == rows[j][1] and unit[i] @ unit[j] > 0.5:
            want.append((-round(float(unit[i] @ unit[j]), 9), i, j))
    want.sort()
    got = [(r.id_left, r.id_right) for r in found.orderBy(F.desc("cosine"), "id_left", "id_right").collect()]
    if keep_best:
        got, want = got[:keep_best], want[:keep_best]
    assert got == [w[1:] for w in want]


def test_rank_within_many_classes(spark, monkeypatch):
    """More classes than may be broadcast: no window over all classes, same ranks."""
    from kindred.operators import ranking

    df = spark.range(400).selectExpr("id", "cast(id % 37 as string) as g", "lpad(cast(997 * id % 401 as string), 4, '0') as o")
    want = sorted(map(tuple, ranking.rank_within(df, "g", F.col("o"), "rank", size="n").collect()))
    monkeypatch.setattr(ranking, "MAX_CLASSES", 5)
    assert sorted(map(tuple, ranking.rank_within(df, "g", F.col("o"), "rank", size="n").collect())) == want
    by_class = {}
    for i, g, o, rank, n in want:
        by_class.setdefault(g, []).append((o, rank, n))
    assert all([r for _, r, _ in sorted(v)] == list(range(1, len(v) + 1)) and v[0][2] == len(v) for v in by_class.values())


def test_split_points_are_bounded(spark):
    from kindred.operators import ranking

    df = spark.range(60).selectExpr("concat(repeat('x', 200), lpad(cast(id as string), 3, '0'), chr(1), repeat('y', 5000)) as k")
    points = ranking.split_points(df, "k", 4)
    assert len(points) == 3 and all(len(p) <= ranking.POINT_CHARS for p in points)
    got = ranking.global_row_number(df, "k").orderBy("k").collect()
    assert [r["rank"] for r in got] == list(range(1, 61))


def test_keys_that_begin_alike_are_spread(spark):
    """300 common characters, a long class name and values that differ only far behind: no range takes nearly all rows."""
    common = "same beginning " * 20
    df = spark.range(4000).select("id", F.concat(F.lit(common), F.lpad(F.col("id").cast("string"), 6, "0")).alias("k"))
    points = rk.split_points(df, "k", 8)
    assert len(points) == 7 and all(len(p) <= len(common) + 6 for p in points)
    rows = [r["count"] for r in df.groupBy(rk.range_of(F.col("k"), points).alias("r")).count().collect()]
    assert len(rows) == 8 and max(rows) < 1500
    got = rk.global_row_number(df, "k").collect()
    assert all(r["rank"] == r.id + 1 for r in got)
    inside = df.select(F.lit("a long class name " * 30).alias("g"), F.lpad(F.col("id").cast("string"), 6, "0").alias("o"))
    keyed = inside.select(rk.order_key("g", "o").alias("k"))
    points = rk.split_points(keyed, "k", 8)
    rows = [r["count"] for r in keyed.groupBy(rk.range_of(F.col("k"), points).alias("r")).count().collect()]
    assert len(rows) == 8 and max(rows) < 1500
    deep = spark.range(900).select(F.concat(F.repeat(F.lit("x"), 5000), F.lpad(F.col("id").cast("string"), 4, "0")).alias("k"))
    assert len(rk.split_points(deep, "k", 4)) == 3


@pytest.mark.parametrize("digits", [1, 4])
def test_bands_of_ranks(spark, monkeypatch, digits):
    """The cuts by counted parts are those of a full sort, for cuts inside, at the ends of and outside the classes."""
    monkeypatch.setattr(rk, "PREFIX_DIGITS", digits)
    rows = [(k, "abc"[k % 7 % 3] if k % 11 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, label string").repartition(4)
    order = F.concat_ws(":", F.md5(F.col("id").cast("string")), F.col("id").cast("string"))
    cuts = lambda sizes: [F.lit(-1), F.lit(0), F.floor(F.col("n") / 3), F.col("n") - 2, F.col("n"), F.lit(10**6)]
    got = {r.id: r.band for r in rk.rank_bands(df, "label", order, cuts).collect()}
    keyed = {r.id: r.o for r in df.select("id", order.alias("o")).collect()}
    for label in ("a", "b", "c", None):
        inside = sorted((keyed[k], k) for k, x in rows if x == label)
        n = len(inside)
        for at, (_, k) in enumerate(inside, 1):
            assert got[k] == sum(at > c for c in (-1, 0, n // 3, n - 2, n, 10**6)), (label, at)
    assert len(got) == 400
    assert rk.rank_bands(df.limit(0), "label", order, cuts).collect() == []
    whole = rk.rank_bands(df, None, order, cuts)
    plan = whole._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "NestedLoop" not in plan
    inside = sorted((keyed[k], k) for k, _ in rows)
    assert {r.id: r.band for r in whole.collect()} == {k: sum(at > c for c in (-1, 0, 133, 398, 400, 10**6)) for at, (_, k) in enumerate(inside, 1)}
    assert rk.rank_bands(df.limit(0), None, order, cuts).collect() == []
