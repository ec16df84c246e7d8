"""Evaluation, sampling and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.operators import evaluation as ev
from kindred.operators import sampling as sm
from kindred.operators.blocking import Block, Neighbourhood, candidate_count
from kindred.plans.linkage import _KEYED, keyed_pairs
from kindred.plans.registry import query, table, view



def _eval_sql(guess):
    return f"""
    WITH t AS (SELECT pair_lo, pair_hi, max(label) AS y FROM {_KEYED} WHERE score < 0.55 GROUP BY 1, 2),
    g AS ({guess}),
    c AS (SELECT count(g.pair_lo) AS n_predicted, count(t.y) AS n_truth, count(*) FILTER (WHERE y = 1) AS n_true,
          count(*) FILTER (WHERE y IS NOT NULL AND g.pair_lo IS NOT NULL) AS n_intersection,
          count(*) FILTER (WHERE y = 1 AND g.pair_lo IS NOT NULL) AS tp
          FROM t FULL OUTER JOIN g ON t.pair_lo = g.pair_lo AND t.pair_hi = g.pair_hi),
    m AS (SELECT *, CASE WHEN n_intersection = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / n_intersection END AS p,
          CASE WHEN n_true = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / n_true END AS r FROM c)
    """


_GUESS = f"SELECT DISTINCT pair_lo, pair_hi FROM {_KEYED} WHERE prediction = 1"
_METRICS = "round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1"


def _judged(spark, sf):
    rows = keyed_pairs(spark, sf).select("pair_lo", "pair_hi", "label", "prediction", "score")
    return rows, rows.filter("score < 0.55")


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    "eval_pairs",
    _eval_sql(_GUESS) + f"SELECT n_predicted, n_truth, n_true, n_intersection, tp, {_METRICS} FROM m",
)
def eval_pairs(spark, sf):
    rows, truth = _judged(spark, sf)
    return _rounded(ev.evaluate_pairs(rows.filter("prediction = 1"), truth).drop("fp", "fn"))


@query("eval_predictions", _eval_sql(_GUESS) + f"SELECT n_predicted, n_intersection, tp, {_METRICS} FROM m")
def eval_predictions(spark, sf):
    rows, truth = _judged(spark, sf)
    out = ev.evaluate_predictions(rows, truth, "prediction")
    return _rounded(out.select("n_predicted", "n_intersection", "tp", "precision", "recall", "f1"))


@query("eval_confusion", _eval_sql(_GUESS) + "SELECT tp, n_intersection - tp AS fp, n_true - tp AS fn FROM m")
def eval_confusion(spark, sf):
    rows, truth = _judged(spark, sf)
    return ev.evaluate_pairs(rows.filter("prediction = 1"), truth).select("tp", "fp", "fn")


_OVERLAP = f"""WITH c AS ({_GUESS}), t AS (SELECT DISTINCT pair_lo, pair_hi FROM {_KEYED} WHERE label = 1)"""


@query(
    "block_stats",
    _OVERLAP
    + """, n AS (SELECT count(*) AS n_candidates FROM c), o AS (SELECT count(*) AS n_overlap FROM c JOIN t USING (pair_lo, pair_hi))
       SELECT n_candidates, n_overlap, round(n_overlap * 100.0 / n_candidates, 6) AS percent FROM n, o""",
)
def block_stats(spark, sf):
    rows = keyed_pairs(spark, sf)
    out = ev.candidate_overlap(rows.filter("prediction = 1"), rows.filter("label = 1"))
    return out.withColumn("percent", F.round("percent", 6))


@query("block_overlap_examples", _OVERLAP + " SELECT pair_lo, pair_hi FROM c JOIN t USING (pair_lo, pair_hi) ORDER BY 1, 2 LIMIT 5")
def block_overlap_examples(spark, sf):
    rows = keyed_pairs(spark, sf)
    return ev.overlap_examples(rows.filter("prediction = 1"), rows.filter("label = 1"))


@query(
    "block_reduction",
    """WITH e AS (SELECT *, dense_rank() OVER (ORDER BY company_name) AS r FROM {entities}),
       n AS (SELECT count(*) AS n FROM e), c AS (SELECT count(*) AS n_candidates FROM e a JOIN e b ON a.rec_id < b.rec_id
         AND (a.city = b.city OR abs(a.r - b.r) <= 1))
       SELECT n_candidates, round(1 - n_candidates / (n * (n - 1) / 2.0), 6) AS reduction FROM n, c""",
)
def block_reduction(spark, sf):
    rows = view(spark, sf, "entities")
    n = rows.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    found = candidate_count(rows, [Block("city"), Neighbourhood("company_name", 3)])
    ratio = 1 - F.col("n_candidates").cast("double") / (n * (n - 1) / 2)
    return found.select(F.col("n_candidates").cast("long"), F.round(ratio, 6).alias("reduction"))


@query(
    "eval_accuracy_f1",
    """SELECT count(*) AS n, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(2.0 * sum(label * prediction) / (sum(label) + sum(prediction)), 6) AS f1 FROM {named_pairs}""",
)
def eval_accuracy_f1(spark, sf):
    out = ev.accuracy_f1(view(spark, sf, "named_pairs").select("label", "prediction"))
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "f1")})


@query(
    "eval_class_report",
    """WITH k AS (SELECT * FROM (VALUES (0), (1)) k(c)),
       per AS (SELECT CAST(c AS VARCHAR) AS class, count(*) FILTER (WHERE label = c AND prediction = c) AS hit,
         count(*) FILTER (WHERE prediction = c) AS guessed, count(*) FILTER (WHERE label = c) AS support
         FROM k, {named_pairs} GROUP BY c),
       m AS (SELECT class, hit / guessed AS p, hit / support AS r, support, hit FROM per),
       f AS (SELECT *, 2 * p * r / (p + r) AS f FROM m)
       SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(support AS BIGINT) AS support FROM f
       UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6),
         round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
       UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM f
       UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
         round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""",
)
def eval_class_report(spark, sf):
    return _rounded(ev.class_report(view(spark, sf, "named_pairs").select("label", "prediction")))


_SWEEP = """WITH s AS (SELECT CAST(i AS INT) AS i, i * CAST(0.01 AS DOUBLE) AS threshold FROM range(0, 101) r(i)),
    c AS (SELECT threshold, sum(CASE WHEN score >= threshold THEN label ELSE 0 END) AS tp,
          sum(CASE WHEN score >= threshold THEN 1 - label ELSE 0 END) AS fp,
          sum(CASE WHEN score < threshold THEN label ELSE 0 END) AS fn FROM s, {pairs} GROUP BY 1),
    f AS (SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
          CAST(fn AS BIGINT) AS fn, CASE WHEN tp + fp + fn + tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM c)"""


@query("eval_threshold_sweep", _SWEEP + " SELECT round(threshold, 6) AS threshold, tp, fp, fn, round(f1, 6) AS f1 FROM f")
def eval_threshold_sweep(spark, sf):
    out = ev.threshold_sweep(view(spark, sf, "pairs").select("score", "label"), "score")
    return out.withColumns({c: F.round(c, 6) for c in ("threshold", "f1")})


@query(
    "eval_best_threshold",
    _SWEEP + " SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, f.threshold LIMIT 1",
)
def eval_best_threshold(spark, sf):
    out = ev.best_threshold(ev.threshold_sweep(view(spark, sf, "pairs").select("score", "label"), "score"))
    return out.withColumns({c: F.round(c, 6) for c in ("threshold", "f1")})


@query("agg_value_counts", "SELECT quality, toxic, count(*) AS n FROM {labels} GROUP BY 1, 2")
def agg_value_counts(spark, sf):
    return ev.value_counts(table(spark, sf, "labels"), "quality", "toxic")


@query(
    "agg_histogram",
    """WITH e AS (SELECT min(score) AS lo, max(score) AS hi FROM {pairs}),
       p AS (SELECT CAST(least(floor((score - lo) / ((hi - lo) / 30)), 29) AS INT) AS bin FROM {pairs}, e),
       c AS (SELECT bin, count(*) AS n FROM p GROUP BY 1)
       SELECT CAST(i AS INT) AS bin, round(lo + i * ((hi - lo) / 30), 6) AS low, round(lo + (i + 1) * ((hi - lo) / 30), 6) AS high,
       coalesce(n, 0) AS n FROM range(0, 30) r(i) CROSS JOIN e LEFT JOIN c ON c.bin = i""",
)
def agg_histogram(spark, sf):
    out = ev.histogram(view(spark, sf, "pairs").select("score"), "score", 30)
    return out.withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query(
    "agg_compare_results",
    """SELECT 'rules' AS result, count(*) AS n_candidates, count(*) FILTER (WHERE score > 0.8) AS n_matches FROM {named_pairs}
       UNION ALL SELECT 'model', count(*), count(*) FILTER (WHERE prediction = 1) FROM {named_pairs}
       UNION ALL SELECT 'truth', count(*), count(*) FROM {named_pairs} WHERE label = 1""",
)
def agg_compare_results(spark, sf):
    rows = view(spark, sf, "named_pairs").select("score", "prediction", "label")
    return ev.compare_results(
        {
            "rules": (rows, F.col("score") > 0.8),
            "model": (rows, F.col("prediction") == 1),
            "truth": (rows.filter("label = 1"), F.lit(True)),
        }
    )


@query(
    "agg_runs_mean",
    """WITH s AS (SELECT event_type AS run, CAST(extract(day FROM ts) AS INT) AS step, sum(value) AS value FROM {events} GROUP BY 1, 2),
       m AS (SELECT step, avg(value) AS mean, count(DISTINCT run) AS n_runs FROM s GROUP BY 1)
       SELECT step, round(mean, 4) AS mean, n_runs, round(max(mean) OVER (), 4) AS max_mean FROM m""",
)
def agg_runs_mean(spark, sf):
    events = table(spark, sf, "events")
    runs = events.groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").alias("step")).agg(F.sum("value").alias("value"))
    return ev.mean_of_runs(runs).withColumns({c: F.round(c, 4) for c in ("mean", "max_mean")})


@query(
    "rule_probability",
    """SELECT id, score, CAST(score >= 0.75 AS INT) AS at_threshold, CAST(score > 0.5 AS INT) AS above_half,
       CASE WHEN score > 1 - score THEN 1 ELSE 0 END AS predicted_label,
       round(exp(score) / (exp(score) + exp(1 - score)), 6) AS softmax FROM {pairs}""",
)
def rule_probability(spark, sf):
    from kindred.operators.learning import argmax, softmax

    p = F.array(1 - F.col("score"), F.col("score"))
    return view(spark, sf, "pairs").select(
        "id",
        "score",
        (F.col("score") >= 0.75).cast("int").alias("at_threshold"),
        (F.col("score") > 0.5).cast("int").alias("above_half"),
        argmax(p).alias("predicted_label"),
        F.round(softmax(p)[1], 6).alias("softmax"),
    )


# ---------------------------------------------------------------- samples and splits

_HASH = "md5('42:' || CAST(id AS VARCHAR))"
_ORDERED = f"row_number() OVER (PARTITION BY label ORDER BY {_HASH}, CAST(id AS VARCHAR))"


@query(
    "sample_balanced",
    f"""WITH r AS (SELECT id, label, score, {_ORDERED} AS k FROM {{pairs}})
        SELECT id, label, score FROM r WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM {{pairs}} GROUP BY label))""",
)
def sample_balanced(spark, sf):
    return sm.balanced(view(spark, sf, "pairs").select("id", "label", "score"), "label", "id")


@query(
    "sample_negatives",
    f"""WITH r AS (SELECT id, label, score, {_ORDERED} AS k FROM {{pairs}})
        SELECT id, label, score FROM r WHERE label = 1 OR k <= 5 * (SELECT count(*) FROM {{pairs}} WHERE label = 1)""",
)
def sample_negatives(spark, sf):
    return sm.capped_negatives(view(spark, sf, "pairs").select("id", "label", "score"), "label", "id")


@query("shuffle_rows", f"SELECT id, label FROM {{pairs}} ORDER BY {_HASH}, id")
def shuffle_rows(spark, sf):
    return sm.shuffled(view(spark, sf, "pairs").select("id", "label"), "id")


@query(
    "split_random",
    f"""SELECT id, label, CASE WHEN x < 0.8 THEN 'train' WHEN x < 0.9 THEN 'valid' ELSE 'test' END AS split FROM
        (SELECT id, label, CAST('0x' || substr({_HASH}, 1, 8) AS BIGINT) / 4294967296.0 AS x FROM {{pairs}})""",
)
def split_random(spark, sf):
    return sm.split_random(view(spark, sf, "pairs").select("id", "label"), "id")


def _split_sql(part, share):
    over = f"OVER ({part}ORDER BY {_HASH}, CAST(id AS VARCHAR))"
    size = f"count(*) OVER ({part.strip()})"
    return f"""SELECT id, label, CASE WHEN k <= n - h THEN 'train' WHEN k <= n - ceil(h / 2.0) THEN 'valid' ELSE 'test' END AS split
        FROM (SELECT *, ceil(round(n * {share}, 6)) AS h FROM
        (SELECT id, label, row_number() {over} AS k, {size} AS n FROM {{pairs}}))"""


@query("split_exact", _split_sql("", 0.2))
def split_exact(spark, sf):
    return sm.split_exact(view(spark, sf, "pairs").select("id", "label"), "id")


@query("split_stratified", _split_sql("PARTITION BY label ", 0.4))
def split_stratified(spark, sf):
    return sm.split_stratified(view(spark, sf, "pairs").select("id", "label"), "label", "id")


_INDEXED = "SELECT rec_id, CASE WHEN raw_type IS NOT NULL THEN size END AS match_index FROM {dirty}"


@query(
    "split_modulo",
    f"SELECT *, CASE match_index % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END AS split FROM ({_INDEXED})",
)
def split_modulo(spark, sf):
    index = F.when(F.col("raw_type").isNotNull(), F.col("size")).alias("match_index")
    return sm.split_modulo(view(spark, sf, "dirty").select("rec_id", index), "match_index")


@query("label_not_null", "SELECT rec_id, raw_type, CAST(raw_type IS NOT NULL AS INT) AS label FROM {dirty}")
def label_not_null(spark, sf):
    return sm.label_not_null(view(spark, sf, "dirty").select("rec_id", "raw_type"), "raw_type")
