import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import evaluation as ev
from kindred.operators import joins as j
from kindred.operators import sampling as sm


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([0.0, 0.29, 0.57, 0.58, 1.0, round(rng.random(), 2)]), int(rng.random() < 0.3)) for k in range(500)]
    return rows, spark.createDataFrame(rows, "id long, score double, label int").repartition(3)


def keyed(spark, rows, schema="l string, r string, label int"):
    return j.with_pair_key(spark.createDataFrame(rows, schema), "l", "r")


def test_pair_metrics(spark):
    truth = keyed(spark, [("a", "b", 1), ("b", "a", 0), ("c", "d", 0), ("e", "f", 1), ("x", "y", 1)])
    guess = keyed(spark, [("b", "a", 1), ("c", "d", 1), ("p", "q", 1), ("e", "f", 0)])
    one = ev.evaluate_predictions(guess, truth).first()
    assert (one.n_predicted, one.n_truth, one.n_true, one.n_intersection, one.tp, one.fp, one.fn) == (3, 4, 3, 2, 1, 1, 2)
    assert one.precision == 0.5 and one.recall == pytest.approx(1 / 3) and one.f1 == pytest.approx(0.4)
    none = ev.evaluate_pairs(guess.limit(0), truth.limit(0)).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)


def test_sweep_equals_one_pass_per_threshold(scored):
    rows, df = scored
    got = {r.threshold: (r.tp, r.fp, r.fn) for r in ev.threshold_sweep(df, "score").collect()}
    assert len(got) == 101
    best = None
    for k in range(101):
        t = k * 0.01
        tp = sum(y for _, s, y in rows if s >= t)
        fp = sum(1 - y for _, s, y in rows if s >= t)
        fn = sum(y for _, s, y in rows if s < t)
        assert got[t] == (tp, fp, fn)
        f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
        if best is None or f1 > best[0]:
            best = (f1, t)
    one = ev.best_threshold(ev.threshold_sweep(df, "score")).first()
    assert (one.f1, one.threshold) == (pytest.approx(best[0]), best[1])


def test_class_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (2, 0)], "label int, prediction int")
    rows = {r["class"]: r for r in ev.class_report(df).collect()}
    assert rows["0"].precision == 0.5 and rows["0"].recall == 1.0 and rows["0"].support == 2
    assert rows["2"].f1 == 0.0 and rows["accuracy"].f1 == pytest.approx(0.6)
    assert rows["macro avg"].recall == pytest.approx(0.5)
    assert rows["weighted avg"].precision == pytest.approx((0.5 * 2 + 1.0 * 2 + 0) / 5)


def test_histogram(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.99,), (0.5,), (None,)], "x double")
    assert [r.n for r in ev.histogram(df, "x", 4).orderBy("bin").collect()] == [1, 0, 1, 2]
    flat = ev.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 2).orderBy("bin").collect()
    assert [(r.low, r.high, r.n) for r in flat] == [(1.5, 2.0, 0), (2.0, 2.5, 2)]
    assert ev.histogram(df.limit(0), "x", 3).count() == 0


def test_runs(spark):
    rows = [("a", 1, 1.0), ("b", 1, 3.0), ("a", 2, 5.0), ("b", 2, 5.0)]
    df = spark.createDataFrame(rows, "run string, step int, value double")
    assert [(r.step, r["mean"], r.max_mean) for r in ev.mean_of_runs(df).orderBy("step").collect()] == [(1, 2.0, 5.0), (2, 5.0, 5.0)]
    with pytest.raises(Exception, match="different steps"):
        ev.mean_of_runs(df.filter("not (run = 'b' and step = 2)")).collect()


def test_overlap(spark):
    a = keyed(spark, [("a", "b", 1), ("b", "a", 1), ("c", "d", 1)])
    t = keyed(spark, [("a", "b", 0), ("z", "z", 1)])
    one = ev.candidate_overlap(a, t).first()
    assert (one.n_candidates, one.n_overlap, one.percent) == (2, 1, 50.0)
    assert ev.overlap_examples(a, t).count() == 1
    assert j.label_membership(a, t).groupBy("label").count().count() == 2
    assert j.intersect_pairs(a, t).count() == 1 and j.union_pairs(a, t).count() == 3
    assert j.pairs_in(a, t).count() == 2


def test_outer_chain_with_hot_and_missing_keys(spark):
    """A third of the rows without a key, keys that are hot on one side, on both and on one side alone: same rows."""
    a = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k % 40, k) for k in range(120)] + [(900, 1000 + k) for k in range(30)]
    b = [(None if k < 4 else k % 50, k) for k in range(60)] + [(5, 70 + k) for k in range(25)] + [(901, 200 + k) for k in range(30)]
    c = [(None, 1), (5, 2), (7, 3), (902, 4), (901, 5)]
    tables = [spark.createDataFrame(rows, f"k int, {v} int") for rows, v in ((a, "v"), (b, "v"), (c, "w"))]
    want = sorted(map(repr, j.outer_chain(tables, "k").collect()))
    for hot in (20, 1):
        got = j.outer_chain(tables, "k", hot_rows=hot)
        assert got.columns == ["k", "v_x", "v_y", "w"]
        assert sorted(map(repr, got.collect())) == want
    keys = {r.key: (r._rows, r._columns) for r in j._hot_keys(
        tables[0].withColumnRenamed("k", "_left_key"), tables[1].withColumnRenamed("k", "_right_key"), 20
    ).collect()}
    assert keys == {None: (2, 1), 5: (3, 2), 900: (2, 1), 901: (1, 2)}


def test_outer_chain_matches_missing_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (None, "m"), (2, "z")], "k int, v string")
    rows = {r.k: (r.v_x, r.v_y) for r in j.outer_chain([a, b], "k").collect()}
    assert rows == {1: ("x", "y"), None: ("n", "m"), 2: (None, "z")}


def test_lookup(spark):
    pairs = spark.createDataFrame([(1, 2, 1), (9, 2, 0)], "ltable_id long, rtable_id long, label int")
    t = spark.createDataFrame([(1, "one", 5), (1, "first", 1), (2, "two", 1)], "id long, name string, line int")
    left = {r.id: (r.sentence1, r.sentence2) for r in j.lookup_pairs(pairs, t.filter("line = 1"), t.filter("line = 1"), F.col("name"), F.col("name")).collect()}
    assert left == {1: ("first", "two"), 9: ("", "two")}
    text = t.withColumn("id", F.col("id").cast("string"))
    ok = j.lookup_pairs_strict(pairs.filter("ltable_id = 1"), t, text, F.col("name"), F.col("name"), "line").first()
    assert (ok.text_left, ok.text_right) == ("first", "two")
    with pytest.raises(Exception, match="no row for pair"):
        j.lookup_pairs_strict(pairs, t, text, F.col("name"), F.col("name"), "line").collect()


def test_samples(scored):
    rows, df = scored
    pos = sum(r[2] for r in rows)
    even = sm.balanced(df, "label", "id")
    assert {r.label: r["count"] for r in even.groupBy("label").count().collect()} == {0: pos, 1: pos}
    again = sm.balanced(df.repartition(7), "label", "id")
    assert {r.id for r in even.collect()} == {r.id for r in again.collect()}
    capped = sm.capped_negatives(df.filter("label = 0 or id < 100"), "label", "id", times=2)
    few = sum(r[2] for r in rows if r[0] < 100)
    assert {r.label: r["count"] for r in capped.groupBy("label").count().collect()} == {0: 2 * few, 1: few}


def test_splits(scored):
    rows, df = scored
    sizes = {r.split: r["count"] for r in sm.split_exact(df, "id").groupBy("split").count().collect()}
    assert sizes == {"train": 400, "valid": 50, "test": 50}
    per = sm.split_stratified(df, "label", "id").groupBy("label", "split").count().collect()
    for label in (0, 1):
        n = sum(r[2] == label for r in rows)
        got = {r.split: r["count"] for r in per if r.label == label}
        held = -(-n * 4 // 10)
        assert got == {"train": n - held, "valid": held - -(-held // 2), "test": -(-held // 2)}
    plan = sm.split_random(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_modulo_and_every_nth(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "k int")
    assert [r.split for r in sm.split_modulo(df, "k").collect()] == ["test", "valid", "train", "train"]
    many = spark.range(100)
    assert [r.id for r in sm.every_nth(many, ["id"], 12, 30).orderBy("id").collect()] == [0, 12, 24]
    n = many.count()
    assert [r.id for r in sm.every_nth(many, ["id"], 12).orderBy("id").collect()] == [r.id for r in many.orderBy("id").collect()][::12] and n > 30


def test_sweep_is_bounded(spark):
    """Scores outside the steps fall into one; NaN and null reach no threshold."""
    rows = [(-5.0, 1), (-0.2, 0), (float("nan"), 1), (None, 1), (7.5, 1), (0.5, 0)]
    sweep = ev.threshold_sweep(spark.createDataFrame(rows, "score double, label int"), "score").collect()
    got = {r.threshold: (r.tp, r.fp, r.fn) for r in sweep}
    assert len(got) == 101 and got[0.0] == (1, 1, 3) and got[1.0] == (1, 0, 3)
