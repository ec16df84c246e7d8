"""Features, training, scoring and encoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.functions import strings as s
from kindred.operators import learning as ln
from kindred.operators import text as t
from kindred.operators.blocking import adjacent_rows
from kindred.operators.evaluation import best_threshold, class_report, threshold_sweep
from kindred.operators.joins import with_pair_key
from kindred.operators.matching import hydrate, profiles
from kindred.plans.registry import query, table, view
from kindred.session import cut_lineage

_TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{N}}_]')"
_ROOM = 61
_CUT = f"""
    k AS (SELECT id, label, {_TOKENS.format('text_a')} AS a, {_TOKENS.format('text_b')} AS b FROM {{turns}}),
    n AS (SELECT *, CASE WHEN len(a) + len(b) <= {_ROOM} THEN len(a)
            ELSE least(len(a), greatest(({_ROOM} + 1) // 2, {_ROOM} - len(b))) END AS ka FROM k),
    c AS (SELECT id, label, a[1:ka] AS a, CASE WHEN len(a) + len(b) <= {_ROOM} THEN b ELSE b[1:{_ROOM} - ka] END AS b FROM n)
"""


@query("pair_truncate", f"WITH {_CUT} SELECT id, len(a) AS n_a, len(b) AS n_b, a[len(a)] AS last_a, b[len(b)] AS last_b FROM c")
def pair_truncate(spark, sf):
    rows = view(spark, sf, "turns").select("id", t.tokenize("text_a").alias("a"), t.tokenize("text_b").alias("b"))
    a, b = t.truncate_pair(F.col("a"), F.col("b"), _ROOM)
    cut = rows.select("id", a.alias("a"), b.alias("b"))
    last = lambda c: F.try_element_at(c, F.size(c))
    return cut.select(
        "id",
        F.size("a").cast("long").alias("n_a"),
        F.size("b").cast("long").alias("n_b"),
        F.when(F.size("a") > 0, last(F.col("a"))).alias("last_a"),
        F.when(F.size("b") > 0, last(F.col("b"))).alias("last_b"),
    )


@query(
    "pair_features",
    f"""WITH {_CUT},
    w AS (SELECT token, row_number() OVER (ORDER BY token) + 3 AS token_id FROM
          (SELECT DISTINCT unnest(a || b) AS token FROM k)),
    f AS (SELECT id, label, len(a) AS la, len(b) AS lb, unnest(a || ['[SEP]'] || CASE WHEN len(b) > 0 THEN b || ['[SEP]'] ELSE [] END) AS token,
          generate_subscripts(a || ['[SEP]'] || CASE WHEN len(b) > 0 THEN b || ['[SEP]'] ELSE [] END, 1) AS pos FROM c),
    i AS (SELECT id, label, la, lb, [2] || list(CASE WHEN f.token = '[SEP]' THEN 3 ELSE token_id END ORDER BY pos) AS ids
          FROM f LEFT JOIN w ON w.token = f.token GROUP BY ALL)
    SELECT id, array_to_string(ids || list_transform(range(0, 64 - len(ids)), lambda x: 0), ' ') AS input_ids,
      repeat('1', len(ids)) || repeat('0', 64 - len(ids)) AS input_mask,
      '1' || repeat('0', la + 1) || repeat('1', CASE WHEN lb > 0 THEN lb + 1 ELSE 0 END) || repeat('0', 64 - len(ids)) AS segment_ids,
      CAST(label AS INT) AS label_id FROM i""",
)
def pair_features(spark, sf):
    rows = view(spark, sf, "turns")
    vocab = t.vocabulary(rows, "text_a", "text_b")
    out = t.pair_features(rows, vocab, ["0", "1"], t.FeatureLayout(max_length=_ROOM + 3))
    joined = lambda c, sep: F.array_join(F.col(c).cast("array<string>"), sep).alias(c)
    return out.select("id", joined("input_ids", " "), joined("input_mask", ""), joined("segment_ids", ""), "label_id")


@query("label_similarity")
def label_similarity(spark, sf):
    ratio = s.fuzzy_ratio("company_name_left", "company_name_right")
    rows = view(spark, sf, "entity_pairs").select("id", "company_name_left", "company_name_right", ratio.alias("ratio"))
    return rows.withColumn("label", (F.col("ratio") >= 92).cast("int"))


def _truth(spark, sf):
    """Neighbours in name order from different sources stand for labelled matches."""
    cols = ["company_name", "_source_table"]
    rows = adjacent_rows(view(spark, sf, "entities"), "company_name", cols=cols)
    pairs = rows.filter("_source_table_left <> _source_table_right")
    return with_pair_key(pairs, "company_name_left", "company_name_right").select("pair_lo", "pair_hi")


_DIGEST = "CAST('0x' || substr(md5('42:' || CAST(k AS VARCHAR)), 1, 15) AS BIGINT)"


@query(
    "training_pairs",
    f"""WITH e AS (SELECT rec_id, lower(trim(company_name)) AS name, _source_table AS src FROM {{entities}} WHERE company_name IS NOT NULL),
    nm AS (SELECT name, substr(name, 1, 1) AS block, min(rec_id) AS rec_id FROM e WHERE name <> '' GROUP BY 1, 2),
    num AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY rec_id) - 1 AS i FROM nm),
    siz AS (SELECT block, count(*) * (count(*) - 1) // 2 AS p FROM num GROUP BY 1),
    off AS (SELECT block, p, sum(p) OVER (ORDER BY block) - p AS s, sum(p) OVER () AS total FROM siz),
    adj AS (SELECT name AS a, src AS sa, lead(name) OVER o AS b, lead(src) OVER o AS sb FROM e WINDOW o AS (ORDER BY name, rec_id)),
    tru AS (SELECT DISTINCT least(a, b) AS lo, greatest(a, b) AS hi FROM adj WHERE sa <> sb AND a <> b),
    pos AS (SELECT least(x.rec_id, y.rec_id) AS id_left, greatest(x.rec_id, y.rec_id) AS id_right
            FROM tru JOIN num x ON x.name = lo JOIN num y ON y.name = hi WHERE x.block = y.block),
    par AS (SELECT 5 * (SELECT count(*) FROM pos) AS wanted, CAST((SELECT max(total) FROM off) AS BIGINT) AS total),
    drw AS (SELECT {_DIGEST} % total AS x, k AS turn FROM par, unnest(range(2 * wanted + 1000)) AS r(k) WHERE 4 * wanted + 2000 < total
            UNION ALL SELECT k, {_DIGEST} FROM par, unnest(range(total)) AS r(k) WHERE 4 * wanted + 2000 >= total),
    pck AS (SELECT x, min(turn) AS turn FROM drw GROUP BY 1),
    pla AS (SELECT turn, block, x - s AS y, CAST(floor((1 + sqrt(1 + 8 * CAST(x - s AS DOUBLE))) / 2) AS BIGINT) AS j
            FROM pck JOIN off ON x >= s AND x < s + p),
    fnd AS (SELECT least(a.rec_id, d.rec_id) AS id_left, greatest(a.rec_id, d.rec_id) AS id_right, turn FROM pla
            JOIN num a ON a.block = pla.block AND a.i = y - j * (j - 1) // 2 JOIN num d ON d.block = pla.block AND d.i = j),
    neg AS (SELECT f.* FROM fnd f ANTI JOIN pos USING (id_left, id_right)),
    fst AS (SELECT id_left, id_right, 0 AS label FROM (SELECT *, row_number() OVER (ORDER BY turn, id_left, id_right) AS r FROM neg), par WHERE r <= wanted),
    bth AS (SELECT id_left, id_right, 1 AS label FROM pos UNION ALL SELECT * FROM fst)
    SELECT id_left, id_right, CAST(label AS INT) AS label, x.name AS name_left, y.name AS name_right,
      round(jaro_winkler_similarity(x.name, y.name), 6) AS jarowinkler
    FROM bth JOIN nm x ON x.rec_id = id_left JOIN nm y ON y.rec_id = id_right""",
)
def training_pairs(spark, sf):
    """Cleaned names, pairs in the truth (of any label) and five times as many drawn ones."""
    rows = cut_lineage(view(spark, sf, "entities").select("rec_id", F.lower(F.trim("company_name")).alias("name"), "_source_table"))
    near = adjacent_rows(rows, "name", cols=["name", "_source_table"]).filter("_source_table_left <> _source_table_right")
    truth = cut_lineage(with_pair_key(near, "name_left", "name_right").select("pair_lo", "pair_hi"))
    both, names = ln.labelled_pairs(rows, truth, "name")
    out = hydrate(both, names, ["name"]).select("id_left", "id_right", "label", "name_left", "name_right")
    return out.withColumn("jarowinkler", F.round(s.jaro_winkler("name_left", "name_right"), 6))


def _model(spark, sf):
    truth = cut_lineage(_truth(spark, sf))
    rows = view(spark, sf, "entities")
    model, validation = ln.train_and_validate(rows, truth, "company_name")
    return rows, model, validation


@query("ml_match_logreg")
def ml_match_logreg(spark, sf):
    """All candidate name pairs the trained model gives a probability of 0.75 or more."""
    rows, model, _ = _model(spark, sf)
    return ln.probable_matches(rows, model, "company_name")


@query("ml_validation_report")
def ml_validation_report(spark, sf):
    """Class report on the held-out pairs at the threshold with the best F1."""
    _, _, validation = _model(spark, sf)
    held = cut_lineage(validation.select("label", "match_prob"))
    best = best_threshold(threshold_sweep(held, "match_prob")).select("threshold").scalar()
    return class_report(held.withColumn("prediction", (F.col("match_prob") >= best).cast("int")))


_NEWTON = ("b0", "b1", "b2")


def _newton_sql(rows: str, steps: int = 30) -> str:
    """Newton steps for the penalised logistic loss over ``rows`` (y, a, b); three equations solved by determinants."""
    h = {(0, 0): "sum(w)", (0, 1): "sum(w * a)", (0, 2): "sum(w * b)", (1, 1): "sum(w * a * a) + 1", (1, 2): "sum(w * a * b)", (2, 2): "sum(w * b * b) + 1"}
    at = lambda i, j: f"h{min(i, j)}{max(i, j)}"

    def det(cols):
        return " + ".join(f"{sign} {cols(0, x)} * {cols(1, y)} * {cols(2, z)}" for sign, (x, y, z) in (
            ("1 *", (0, 1, 2)), ("1 *", (1, 2, 0)), ("1 *", (2, 0, 1)), ("-1 *", (2, 1, 0)), ("-1 *", (1, 0, 2)), ("-1 *", (0, 2, 1))))

    solved = ", ".join(f"{b} - ({det(lambda i, j, k=k: f'g{i}' if j == k else at(i, j))}) / ({det(at)}) AS {b}" for k, b in enumerate(_NEWTON))
    sums = ", ".join(f"{e} AS h{i}{j}" for (i, j), e in h.items())
    return f"""it AS (SELECT 0 AS k, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 UNION ALL
      SELECT k + 1 AS k, {solved} FROM (SELECT k, b0, b1, b2, sum(p - y) AS g0, sum((p - y) * a) + b1 AS g1, sum((p - y) * b) + b2 AS g2, {sums}
        FROM (SELECT it.*, y, a, b, 1 / (1 + exp(-(b0 + b1 * a + b2 * b))) AS p, p * (1 - p) AS w FROM it, ({rows}) AS t WHERE k < {steps}) GROUP BY k, b0, b1, b2))"""


_PAIR_ROWS = """SELECT label AS y, jaro_winkler_similarity(company_name_left, company_name_right) AS a,
    1.0 - levenshtein(company_name_left, company_name_right) / greatest(length(company_name_left), length(company_name_right)) AS b FROM {entity_pairs}"""


@query(
    "ml_fit_weights",
    f"""WITH RECURSIVE t AS MATERIALIZED ({_PAIR_ROWS}), {_newton_sql('SELECT * FROM t')},
        last AS (SELECT unnest(['intercept', 'jarowinkler', 'levenshtein']) AS feature, unnest([b0, b1, b2]) AS weight FROM it WHERE k = 30)
        SELECT feature, round(weight, 2) AS weight, 0.0::DOUBLE AS gradient FROM last""",
)
def ml_fit_weights(spark, sf):
    """Weights of the match model over the labelled pairs, and the slope of the penalised loss there."""
    left, right = F.col("company_name_left"), F.col("company_name_right")
    measures = {"jarowinkler": s.jaro_winkler(left, right), "levenshtein": s.levenshtein_similarity(left, right)}
    rows = cut_lineage(view(spark, sf, "entity_pairs").select("label", left, right).withColumns(measures).select("label", *measures))
    model = ln.fit_match_model(rows, list(measures), tolerance=1e-12, steps=500)
    slopes = ln.fit_gradient(rows, model, list(measures))
    # adding 0 turns a negative zero into a plain one
    return slopes.select("feature", F.round("weight", 2).alias("weight"), (F.round("gradient", 5) + 0.0).alias("gradient"))


@query("kmeans_nearest", "SELECT vec_id, TRUE AS nearest, TRUE AS settled FROM {embeddings}")
def kmeans_nearest(spark, sf):
    """Every vector's own centre is the nearest one, and the clustering has come to rest."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return ln.cluster_check(rows, "embedding", "vec_id").select("vec_id", "nearest", "settled")


@query("match_embeddings")
def match_embeddings(spark, sf):
    """Encoded name and country, clustered; pairs of a cluster above 0.8, the best 50,000."""
    named = view(spark, sf, "entities").select("rec_id", F.concat_ws("|", "company_name", "country").alias("text"))
    return ln.embedded_matches(profiles(named, ["text"]), "text")


@query(
    "score_pairs_hook",
    """SELECT id, sentence1, sentence2, round(jaro_winkler_similarity(sentence1, sentence2), 6) AS match_score,
       CAST(jaro_winkler_similarity(sentence1, sentence2) > 0.5 AS INT) AS predicted_label FROM
       (SELECT id, company_name_left AS sentence1, company_name_right AS sentence2 FROM {entity_pairs})""",
)
def score_pairs_hook(spark, sf):
    rows = view(spark, sf, "entity_pairs").select(
        "id", F.col("company_name_left").alias("sentence1"), F.col("company_name_right").alias("sentence2")
    )
    return ln.score_pairs(rows, ln.winkler_scorer).withColumn("match_score", F.round("match_score", 6))


@query(
    "encode_hash_ngrams",
    """WITH d AS (SELECT doc_id, list_transform(string_split(lower(text), ''), lambda c: unicode(c)) AS c FROM {documents}),
       g AS (SELECT doc_id, unnest(list_transform(range(1, len(c) - 1), lambda i:
             (c[i] * 961 + c[i + 1] * 31 + c[i + 2]) % 64)) AS spot FROM d),
       n AS (SELECT doc_id, spot, count(*) AS n FROM g GROUP BY ALL)
       SELECT d.doc_id, array_to_string(list_transform(range(0, 64), lambda k: coalesce(m[k], 0)), ' ') AS vector
       FROM d LEFT JOIN (SELECT doc_id, map_from_entries(list((spot, n))) AS m FROM n GROUP BY 1) USING (doc_id)""",
)
def encode_hash_ngrams(spark, sf):
    out = ln.hashed_ngrams(table(spark, sf, "documents"), "doc_id", "text")
    return out.select("doc_id", F.array_join(F.col("vector").cast("array<int>").cast("array<string>"), " ").alias("vector"))
