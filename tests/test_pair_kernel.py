"""The pair join's kernels: similarities by bits, large blocks value by value, pairs in lists."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions.strings import Encoded, round_half_up
from kindred.operators import blocking as b
from kindred.operators import matching as mt
from kindred.operators.pairjoin import Candidates, NameFloors, similar_pairs
from kindred.sources.readers import read_pair_table
from kindred.sources.writers import write_pairs
from tests.test_functions import plain_jaro_winkler as jw


def words(n, longest, letters="abcé中 ", seed=1):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)})


@pytest.mark.parametrize("longest", [5, 16, 17, 33, 64, 70])
def test_jaro_winkler_by_bits(longest):
    texts = words(60, longest)
    encoded = Encoded(texts)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    got = encoded.jaro_winkler(i, j)
    assert got.tolist() == [pytest.approx(jw(texts[p], texts[q]), abs=1e-12) for p, q in zip(i, j, strict=True)]
    assert (got == encoded._jaro_winkler_long(i, j)).all() and (got == encoded.jaro_winkler(j, i)).all()
    assert (encoded.similarity(i, j) == got).all() and (encoded.similarity(j[::-1], i[::-1]) == got[::-1]).all()


@pytest.mark.parametrize("floor", [-0.1, 0.0, 0.45, 0.7, 0.8, 0.95])
def test_no_pair_above_the_floor_is_unlikely(floor):
    texts = words(220, 12, "abcdefgh ")
    encoded = Encoded(texts)
    half = np.arange(len(texts))[::2]
    for x, y, inner in ((half, half, True), (half, np.arange(len(texts))[1::2], False)):
        found = [(p, q) for a, c in encoded.likely(x, y, floor, inner) for p, q in zip(a.tolist(), c.tolist(), strict=True)]
        if inner:
            found = [tuple(sorted(f)) for f in found]
        assert len(set(found)) == len(found)
        want = {(p, q) for p in range(len(x)) for q in range(p if inner else 0, len(y)) if jw(texts[x[p]], texts[y[q]]) > floor}
        assert want <= set(found)


def records(n, seed=3):
    rng = random.Random(seed)
    names = [f"{a} {c}{k}" for a in ("red gear", "red gate", "old plate", "x") for c in "ab" for k in range(9)] + [None, ""]
    rows = [(k, rng.choice(names), rng.choice(["steel", "steal", "brass", None]), rng.choice(["rome", "oslo"])) for k in range(n)]
    return rows + rows[:3]


@pytest.mark.parametrize("tile_rows", [2048, 150])
def test_large_blocks_equal_brute_force(spark, tile_rows):
    """Blocks whose values are held against each other, whole and cut into tiles, with copies, repeated and missing values."""
    rows = records(420)
    df = spark.createDataFrame(rows, "rec_id long, name string, industry string, city string")
    rule = mt.band_or_similar("name", "industry", "city")
    cols = ["name", "industry", "city"]
    got = mt.link_records(df, cols, [b.Block("city"), b.Neighbourhood("name", 3)], rule, "name", tile_rows=tile_rows).collect()
    order = {n: k for k, n in enumerate(sorted({r[1] for r in rows if r[1] is not None}))}
    want = []
    for x, y in itertools.combinations(rows, 2):
        if x[0] == y[0] or None in (x[1], y[1]) or x[1] == y[1] or not (x[3] == y[3] or abs(order[x[1]] - order[y[1]]) <= 1):
            continue
        name, industry, city = (round(jw(p, q), 9) if p is not None and q is not None else 0.0 for p, q in zip(x[1:], y[1:], strict=True))
        if 0.8 < name < 0.92 or (name > 0.9 and industry > 0.5 and city > 0.5):
            x, y = sorted((x, y))
            want.append((x[0], y[0], x[1], y[1], x[2], y[2], name, industry, city))
    found = [(r.id_left, r.id_right, r.name_left, r.name_right, r.industry_left, r.industry_right, r.name_sim, r.industry_sim, r.city_sim) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str) and len(want) > 5000


@pytest.mark.parametrize("small", [0, 10**9])
def test_pairs_by_value_and_one_by_one(spark, small):
    """Two floors, equal names allowed, anchors: the same pairs whichever way a unit is gone through."""
    rows = records(120)[:120]
    df = spark.createDataFrame(rows, "rec_id long, name string, industry string, city string")
    kernel = NameFloors({"name": 0.7, "industry": 0.6}, anchor="anchor")
    kernel._SMALL = small
    members = b.Block("city").members(df).withColumn("anchor", F.col("rec_id") % 3 == 0)
    got = similar_pairs(members, kernel, tile_rows=25).collect()
    want = {}
    for x, y in itertools.combinations(rows, 2):
        if x[3] == y[3] and None not in (*x[1:3], *y[1:3]) and (x[0] % 3 == 0 or y[0] % 3 == 0) and jw(x[1], y[1]) > 0.7 and jw(x[2], y[2]) > 0.6:
            want[(x[0], y[0])] = (pytest.approx(jw(x[1], y[1])), pytest.approx(jw(x[2], y[2])))
    assert {(r.id_left, r.id_right): (r.name_sim, r.industry_sim) for r in got} == want and len(got) == len(want) > 100


@pytest.mark.parametrize("common", [0, 3, 1024])
def test_overlapping_blocks_are_told_apart_by_bits(common):
    """Shared blocks are told by bits, and rare ones beyond them by their numbers; a pair is kept in its first block alone."""
    import pandas as pd

    rng = random.Random(8)
    held = [sorted(rng.sample([f"0:k{k:02}" for k in range(30)], rng.randint(1, 9))) for _ in range(40)]
    flat = [(r, key) for r, keys in enumerate(held) for key in keys]
    rows = pd.DataFrame({"block": [key for _, key in flat], "_in0": [np.array(held[r], dtype=object) for r, _ in flat], "_of": 0})
    kernel = Candidates({}, places={"_in0": None})
    kernel._COMMON = common
    lists = kernel._lists(rows["_in0"], rows["block"], (rows["_of"] == 0).to_numpy())
    assert all(word.dtype == np.uint64 for word in lists[0])
    ready = (None, None, [(None, lists)], rows["_of"].to_numpy())
    i, j = (np.array(x) for x in zip(*[(p, q) for p, q in itertools.combinations(range(len(flat)), 2) if flat[p][1] == flat[q][1]], strict=True))
    first, bits = kernel._once(ready, i, j)
    assert first.tolist() == [flat[p][1] == min(set(held[flat[p][0]]) & set(held[flat[q][0]])) for p, q in zip(i, j, strict=True)]
    assert (bits == 1).all() and 0 < first.sum() < len(first)


def test_lists_stay_below_what_follows(spark):
    """Whatever follows a linkage, the lists in which pairs travel are not in a row per pair."""
    df = spark.createDataFrame(records(60), "rec_id long, name string, industry string, city string")
    found = mt.link_records(df, ["name", "city"], [b.Block("city")], mt.open_band(["name"], "name"), "name")
    after = found.withColumn("both", F.array_compact(F.array("name_left", "city_right"))).filter(F.size("both") > 1)
    lines = [x.strip(" +-:") for x in after._jdf.queryExecution().optimizedPlan().toString().split("\n")]
    at = next(k for k, x in enumerate(lines) if x.startswith("Generate"))
    assert lines[at - 1].startswith("Project") and "array_compact" not in lines[at - 1] and lines[at - 2].startswith("Filter")


@pytest.mark.parametrize("conf,value", [("spark.sql.codegen.wholeStage", "false"), ("spark.sql.codegen.maxFields", "9")])
def test_pairs_without_generated_code(spark, conf, value):
    rows = records(80)
    df = spark.createDataFrame(rows, "rec_id long, name string, industry string, city string")
    link = lambda: sorted(map(str, mt.link_records(df, ["name", "city"], [b.Block("city")], mt.open_band(["name"], "name"), "name").collect()))
    want, before = link(), spark.conf.get(conf)
    spark.conf.set(conf, value)
    try:
        assert link() == want and want
    finally:
        spark.conf.set(conf, before)


def test_rounding_is_that_of_spark(spark):
    rng = random.Random(4)
    values = [rng.random() for _ in range(3000)] + [k / 1024 / 10**s for k in range(1, 1024, 2) for s in (0, 1)] + [0.0, 1.0, 0.1234567895, 0.1234567885]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", F.round("v", 9).alias("want"), mt.rounded(F.col("v")).alias("got"))
    rows = df.collect()
    assert all(r.want == r.got for r in rows)
    assert round_half_up(np.array([r.v for r in rows]), 9).tolist() == [r.want for r in rows]


def test_compressed_pair_lines_lose_nothing(spark, tmp_path):
    odd = ["plain", "a\tb", "x\ny", "", None, "back\\slash", "\\", "\\\\t", "\\N", "\x00\x01", "\\\\n\\", " é "]
    rows = [(k, a, b, None if k % 3 else k) for k, (a, b) in enumerate(itertools.product(odd, odd))]
    schema = "id long, sentence1 string, sentence2 string, n_pairs long"
    write_pairs(spark.createDataFrame(rows, schema).repartition(3), str(tmp_path / "p"), "gzip")
    back = read_pair_table(spark, str(tmp_path / "p"), schema)
    assert sorted(map(tuple, back.collect()), key=lambda x: x[0]) == rows
    assert {f.suffix for f in (tmp_path / "p").glob("part-*")} == {".gz"}


def test_the_export_is_written_compressed(spark, monkeypatch, tmp_path):
    """Lines of pairs outgrow the records they name."""
    import __spark_entry__ as entry
    from kindred.plans import linkage

    monkeypatch.setattr(linkage, "workspace", lambda spark, label: str(tmp_path / label))
    rows = entry.queries()["export_blocked_pairs"](spark, "/root/testdata/sf0.001").count()
    files = list((tmp_path / "blocked.tsv").glob("part-*"))
    assert rows and files and all(f.suffix == ".gz" for f in files)
