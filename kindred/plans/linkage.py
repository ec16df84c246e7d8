"""Blocking, similarity, rules, linkage and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import strings as s
from kindred.functions.cleaning import normalize_name, strip_lower
from kindred.operators import blocking as b
from kindred.operators import joins as j
from kindred.operators import matching as mt
from kindred.operators.evaluation import evaluate_pairs
from kindred.operators.learning import cluster_vectors, score_pairs, similar_vectors, winkler_scorer
from kindred.operators.ranking import row_index, sortable_long
from kindred.operators.sampling import every_nth, top_pairs
from kindred.operators.tfidf import canopies, similar_texts
from kindred.plans.registry import query, table, view
from kindred.session import cut_lineage, workspace
from kindred.sources.readers import read_pair_table
from kindred.sources.writers import write_pairs

# ---------------------------------------------------------------- joins


@query(
    "join_full_outer_chain",
    """SELECT coalesce(ab.k, n.n_nationkey) AS nation, ab.n_customers, ab.n_suppliers, n.n_name FROM
       (SELECT coalesce(a.k, b.k) AS k, n_customers, n_suppliers FROM
         (SELECT CASE WHEN c_nationkey < 20 THEN c_nationkey END AS k, count(*) AS n_customers FROM {customer} GROUP BY 1) a
         FULL OUTER JOIN (SELECT CASE WHEN s_nationkey > 4 THEN s_nationkey END AS k, count(*) AS n_suppliers FROM {supplier} GROUP BY 1) b
         ON a.k IS NOT DISTINCT FROM b.k) ab
       FULL OUTER JOIN {nation} n ON ab.k IS NOT DISTINCT FROM n.n_nationkey""",
)
def join_full_outer_chain(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.when(F.col("c_nationkey") < 20, F.col("c_nationkey")).alias("nation"))
    v = table(spark, sf, "supplier").groupBy(F.when(F.col("s_nationkey") > 4, F.col("s_nationkey")).alias("nation"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    counts = [c.agg(F.count(F.lit(1)).alias("n_customers")), v.agg(F.count(F.lit(1)).alias("n_suppliers"))]
    return j.outer_chain([*counts, n], "nation")


_ENTITY = ["company_name", "industry", "city", "country"]


@query(
    "join_hydrate_pairs",
    """SELECT q.id, q.ltable_id AS id_left, q.rtable_id AS id_right, a.company_name AS company_name_left,
       a.industry AS industry_left, b.company_name AS company_name_right, b.industry AS industry_right
       FROM {pairs} q LEFT JOIN {entities} a ON a.rec_id = q.ltable_id LEFT JOIN {entities} b ON b.rec_id = q.rtable_id""",
)
def join_hydrate_pairs(spark, sf):
    pairs = view(spark, sf, "pairs").select("id", F.col("ltable_id").alias("id_left"), F.col("rtable_id").alias("id_right"))
    return mt.hydrate(pairs, view(spark, sf, "entities"), ["company_name", "industry"])


@query(
    "join_pair_lookup_strict",
    """SELECT q.id, q.ltable_id, q.rtable_id, q.label, a.p_name AS text_left, b.p_name || ' ' || b.p_type AS text_right
       FROM {pairs} q JOIN {part} a ON a.p_partkey = q.ltable_id JOIN {part} b ON b.p_partkey = q.rtable_id""",
)
def join_pair_lookup_strict(spark, sf):
    part = table(spark, sf, "part").withColumnRenamed("p_partkey", "id")
    pairs = view(spark, sf, "pairs").drop("score")
    return j.lookup_pairs_strict(pairs, part, part, F.col("p_name"), F.concat_ws(" ", "p_name", "p_type"), "p_retailprice")


def keyed_pairs(spark, sf):
    return j.with_pair_key(view(spark, sf, "named_pairs"), "name_left", "name_right")


_KEYED = """(SELECT *, least(name_left, name_right) AS pair_lo, greatest(name_left, name_right) AS pair_hi
             FROM {named_pairs})"""


@query(
    "join_semi_pairs",
    f"""SELECT id, pair_lo, pair_hi FROM {_KEYED} p WHERE prediction = 1 AND EXISTS
        (SELECT 1 FROM {_KEYED} t WHERE t.label = 1 AND t.pair_lo = p.pair_lo AND t.pair_hi = p.pair_hi)""",
)
def join_semi_pairs(spark, sf):
    rows = keyed_pairs(spark, sf).select("id", "pair_lo", "pair_hi", "label", "prediction")
    return j.pairs_in(rows.filter("prediction = 1"), rows.filter("label = 1")).select("id", "pair_lo", "pair_hi")


@query(
    "join_semi_truth",
    f"""SELECT id, pair_lo, pair_hi, label FROM {_KEYED} t WHERE label = 1 AND EXISTS
        (SELECT 1 FROM {_KEYED} p WHERE p.prediction = 1 AND t.pair_lo = p.pair_lo AND t.pair_hi = p.pair_hi)""",
)
def join_semi_truth(spark, sf):
    rows = keyed_pairs(spark, sf).select("id", "pair_lo", "pair_hi", "label", "prediction")
    return j.pairs_in(rows.filter("label = 1"), rows.filter("prediction = 1")).drop("prediction")


@query(
    "join_membership_label",
    f"""SELECT id, pair_lo, pair_hi, CAST(CASE WHEN EXISTS (SELECT 1 FROM {_KEYED} t WHERE t.label = 1
        AND t.pair_lo = p.pair_lo AND t.pair_hi = p.pair_hi) THEN 1 ELSE 0 END AS INT) AS label FROM {_KEYED} p""",
)
def join_membership_label(spark, sf):
    rows = keyed_pairs(spark, sf).select("id", "pair_lo", "pair_hi", "label")
    return j.label_membership(rows.drop("label"), rows.filter("label = 1"))


@query(
    "filter_not_identical",
    """SELECT id, industry_left, industry_right FROM {entity_pairs}
       WHERE NOT coalesce(industry_left = industry_right, FALSE)""",
)
def filter_not_identical(spark, sf):
    rows = view(spark, sf, "entity_pairs").select("id", "industry_left", "industry_right")
    return rows.filter(mt.not_identical(F.col("industry_left"), F.col("industry_right")))


@query("set_distinct_pairs", f"SELECT DISTINCT pair_lo, pair_hi FROM {_KEYED}")
def set_distinct_pairs(spark, sf):
    return j.distinct_pairs(keyed_pairs(spark, sf))


@query(
    "set_intersect_pairs",
    f"""SELECT pair_lo, pair_hi FROM {_KEYED} WHERE label = 1
        INTERSECT SELECT pair_lo, pair_hi FROM {_KEYED} WHERE prediction = 1""",
)
def set_intersect_pairs(spark, sf):
    rows = keyed_pairs(spark, sf)
    return j.intersect_pairs(rows.filter("label = 1"), rows.filter("prediction = 1"))


@query(
    "set_union_pairs",
    f"""SELECT pair_lo, pair_hi FROM {_KEYED} WHERE label = 1
        UNION SELECT pair_lo, pair_hi FROM {_KEYED} WHERE prediction = 1""",
)
def set_union_pairs(spark, sf):
    rows = keyed_pairs(spark, sf)
    return j.union_pairs(rows.filter("label = 1"), rows.filter("prediction = 1"))


# ---------------------------------------------------------------- blocking


@query(
    "block_exact",
    """SELECT p_partkey AS rec_id, p_brand, p_type, p_size, block_size FROM
       (SELECT *, count(*) OVER (PARTITION BY p_brand, p_type, p_size) AS block_size FROM {part}) WHERE block_size > 1""",
)
def block_exact(spark, sf):
    part = table(spark, sf, "part").withColumnRenamed("p_partkey", "rec_id")
    return b.exact_blocks(part, ["p_brand", "p_type", "p_size"])


@query(
    "block_first_letter",
    """SELECT substr(company_name, 1, 1) AS letter, count(*) AS n_records, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS n_pairs
       FROM {entities} GROUP BY 1""",
)
def block_first_letter(spark, sf):
    rows = strip_lower(view(spark, sf, "entities").select("company_name"))
    letters = rows.withColumn("letter", b.FirstLetter("company_name").key())
    return b.block_sizes(letters, ["letter"]).withColumn("n_pairs", F.col("n_pairs").cast("long"))


_RANKED = """(SELECT company_name AS v, count(*) AS n, row_number() OVER (ORDER BY company_name) AS r
             FROM {entities} GROUP BY company_name)"""


@query(
    "block_sorted_neighbourhood",
    f"""SELECT a.v AS value_left, c.v AS value_right, a.r AS rank_left, CAST(c.r - a.r AS INT) AS distance,
        a.n AS n_left, c.n AS n_right, CAST(CASE WHEN a.r = c.r THEN a.n * (a.n - 1) / 2 ELSE a.n * c.n END AS BIGINT) AS n_pairs
        FROM {_RANKED} a JOIN {_RANKED} c ON c.r - a.r BETWEEN 0 AND 2 WHERE a.r <> c.r OR a.n > 1""",
)
def block_sorted_neighbourhood(spark, sf):
    found = b.neighbour_values(view(spark, sf, "entities"), "company_name", 5)
    return found.select(
        "value_left", "value_right", "rank_left", "distance", "n_left", "n_right", F.col("n_pairs").cast("long")
    )


@query(
    "block_sn_rows",
    """WITH r AS (SELECT rec_id, row_number() OVER (ORDER BY company_name, rec_id) AS k FROM {entities})
       SELECT least(a.rec_id, c.rec_id) AS id_left, greatest(a.rec_id, c.rec_id) AS id_right, a.k AS rank_left,
       CAST(c.k - a.k AS INT) AS distance FROM r a JOIN r c ON c.k = a.k + 1 OR c.k = a.k + 2""",
)
def block_sn_rows(spark, sf):
    return b.neighbour_rows(view(spark, sf, "entities"), "company_name", reach=2)


_THREE = [b.Block("industry"), b.Block("city"), b.Neighbourhood("company_name", 5)]

_CAND = """SELECT count(*) AS n_candidates FROM e a JOIN e c ON a.rec_id < c.rec_id AND ({on})"""
_RANKS = """WITH e AS (SELECT *, dense_rank() OVER (ORDER BY company_name) AS r FROM {entities})"""


@query("block_union", _RANKS + _CAND.format(on="a.industry = c.industry OR a.city = c.city OR abs(a.r - c.r) <= 2"))
def block_union(spark, sf):
    total = b.candidate_count(view(spark, sf, "entities"), _THREE)
    return total.select(F.col("n_candidates").cast("long"))


@query(
    "block_multi_set",
    _RANKS + _CAND.format(on="nullif(a.country, '') = nullif(c.country, '') OR a.city = c.city OR abs(a.r - c.r) <= 2"),
)
def block_multi_set(spark, sf):
    # country with neighbours, united with city with the same neighbours
    sets = [b.Block("country"), b.Block("city"), b.Neighbourhood("company_name", 5)]
    return b.candidate_count(view(spark, sf, "entities"), sets).select(F.col("n_candidates").cast("long"))


@query(
    "block_cluster_label",
    "SELECT label, count(*) AS n_records, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS n_pairs FROM {embeddings} GROUP BY 1",
)
def block_cluster_label(spark, sf):
    sizes = b.block_sizes(table(spark, sf, "embeddings").select("label"), ["label"])
    return sizes.withColumn("n_pairs", F.col("n_pairs").cast("long"))


@query("block_kmeans")
def block_kmeans(spark, sf):
    rows = cluster_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", k=50)
    return similar_vectors(rows, "cluster", "embedding", "vec_id", 0.8)


# centres one after another in id order, each taking its neighbours
_CANOPIES = """WITH RECURSIVE d AS (SELECT lower(company_name) AS t, min(rec_id) AS id, count(*) AS n FROM {entities} GROUP BY 1),
    g AS (SELECT id, n, unnest(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) AS term FROM d),
    tf AS (SELECT id, n, term, count(*) AS tf FROM g GROUP BY ALL),
    df AS (SELECT term, sum(n) AS df FROM tf GROUP BY 1),
    w AS (SELECT id, term, tf * (ln((1 + (SELECT sum(n) FROM d)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)),
    u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w),
    e AS MATERIALIZED (SELECT a.id AS i, b.id AS o, round(sum(a.w * b.w), 9) AS cosine
      FROM u a JOIN u b ON a.term = b.term AND a.id <> b.id GROUP BY 1, 2 HAVING round(sum(a.w * b.w), 9) >= 0.5),
    nb AS MATERIALIZED (SELECT d.id, coalesce(list(o) FILTER (o IS NOT NULL), []) AS l FROM d LEFT JOIN e ON i = id GROUP BY 1),
    s AS (SELECT id AS c, l AS taken FROM nb WHERE id = (SELECT min(id) FROM d)
      UNION ALL SELECT x.id, list_distinct(list_concat(x.taken, x.l)) FROM (
        SELECT nb.id, nb.l, s.taken, row_number() OVER (ORDER BY nb.id) AS k
        FROM s JOIN nb ON nb.id > s.c AND NOT list_contains(s.taken, nb.id)) x WHERE x.k = 1),
    m AS MATERIALIZED (SELECT c AS canopy, o AS rec_id, cosine FROM s JOIN e ON e.i = s.c UNION ALL SELECT c, c, 1.0 FROM s)"""


@query("block_canopy", _CANOPIES + " SELECT canopy, rec_id, cosine FROM m")
def block_canopy(spark, sf):
    names = canopy_names(spark, sf)
    return canopies(names, "name", copies="n_records")


def canopy_names(spark, sf):
    rows = view(spark, sf, "entities").select("rec_id", normalize_name("company_name").alias("name"))
    return mt.profiles(rows, ["name"])


@query(
    "pair_adjacent",
    """SELECT rec_id AS rec_id_left, lead(rec_id) OVER w AS rec_id_right, company_name AS company_name_left,
       lead(company_name) OVER w AS company_name_right, row_number() OVER w AS rank FROM {entities}
       WINDOW w AS (ORDER BY company_name, rec_id) QUALIFY rec_id_right IS NOT NULL""",
)
def pair_adjacent(spark, sf):
    return b.adjacent_rows(view(spark, sf, "entities"), "company_name")


@query("row_index", "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS row_id FROM {documents}")
def row_index_query(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source")
    return row_index(rows, F.col("source"), sortable_long("doc_id")).select("doc_id", "row_id")


# ---------------------------------------------------------------- similarity


def _jw(col, digits=6):
    return f"round(jaro_winkler_similarity({col}_left, {col}_right), {digits})"


@query("sim_jaro_winkler", f"SELECT id, {_jw('company_name')} AS name_sim FROM {{entity_pairs}}")
def sim_jaro_winkler(spark, sf):
    rows = view(spark, sf, "entity_pairs")
    return rows.select("id", F.round(s.jaro_winkler("company_name_left", "company_name_right"), 6).alias("name_sim"))


@query(
    "sim_exact",
    "SELECT id, CAST(coalesce(industry_left = industry_right, FALSE) AS INT) AS industry_exact FROM {entity_pairs}",
)
def sim_exact(spark, sf):
    return view(spark, sf, "entity_pairs").select("id", s.exact("industry_left", "industry_right").alias("industry_exact"))


@query("sim_sequence_ratio")
def sim_sequence_ratio(spark, sf):
    rows = view(spark, sf, "entity_pairs")
    return rows.select("id", F.round(s.sequence_ratio("company_name_left", "company_name_right"), 6).alias("ratio"))


@query("sim_fuzz_ratio")
def sim_fuzz_ratio(spark, sf):
    rows = view(spark, sf, "entity_pairs")
    return rows.select("id", s.fuzzy_ratio("industry_left", "industry_right").alias("ratio"))


@query(
    "sim_levenshtein_norm",
    """SELECT id, round(1.0 - levenshtein(company_name_left, company_name_right) /
       greatest(length(company_name_left), length(company_name_right)), 6) AS similarity FROM {entity_pairs}""",
)
def sim_levenshtein_norm(spark, sf):
    value = s.levenshtein_similarity(F.col("company_name_left"), F.col("company_name_right"))
    return view(spark, sf, "entity_pairs").select("id", F.round(value, 6).alias("similarity"))


@query(
    "sim_both_empty_zero",
    f"SELECT id, CASE WHEN country_left = '' AND country_right = '' THEN 0.0 ELSE {_jw('country')} END AS country_sim FROM {{entity_pairs}}",
)
def sim_both_empty_zero(spark, sf):
    left, right = F.col("country_left"), F.col("country_right")
    value = s.both_empty_zero(left, right, F.round(s.jaro_winkler(left, right), 6))
    return view(spark, sf, "entity_pairs").select("id", value.alias("country_sim"))


_ALL = ("company_name", "industry", "city", "country", "ownership")


@query(
    "sim_all_columns",
    "SELECT id, " + ", ".join(f"coalesce({_jw(c)}, 0.0) AS {c}_similarity" for c in _ALL) + " FROM {entity_pairs}",
)
def sim_all_columns(spark, sf):
    rows = view(spark, sf, "entity_pairs")
    cols = [F.round(s.jaro_winkler(f"{c}_left", f"{c}_right"), 6).alias(f"{c}_similarity") for c in _ALL]
    return rows.select("id", *cols)


_ROLES = {"name": "company_name", "industry": "industry", "city": "city", "country": "country", "ownership": "ownership"}


def _score_sql(alias=True):
    terms = [f"coalesce({_jw(c, 9)}, 0.0) * {mt.WEIGHTS[r]}" for r, c in _ROLES.items()]
    return f"({' + '.join(terms)})"


@query("score_weighted", f"SELECT id, round({_score_sql()}, 9) AS weighted_score FROM {{entity_pairs}}")
def score_weighted(spark, sf):
    rows = view(spark, sf, "entity_pairs")
    sims = rows.select(
        "id", *[F.round(s.jaro_winkler(f"{c}_left", f"{c}_right"), 9).alias(f"{r}_sim") for r, c in _ROLES.items()]
    )
    return sims.select("id", mt.weighted_score({r: f"{r}_sim" for r in _ROLES}).alias("weighted_score"))


@query(
    "sim_cosine",
    """SELECT a.vec_id AS id_left, b.vec_id AS id_right,
       round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS cosine
       FROM {embeddings} a JOIN {embeddings} b ON a.label = b.label AND a.vec_id < b.vec_id
       WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.2""",
)
def sim_cosine(spark, sf):
    return similar_vectors(table(spark, sf, "embeddings"), "label", "embedding", "vec_id", 0.2)


@query(
    "topk_similar_pairs",
    """SELECT a.vec_id AS id_left, b.vec_id AS id_right,
       round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS cosine
       FROM {embeddings} a JOIN {embeddings} b ON a.label = b.label AND a.vec_id < b.vec_id
       ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) DESC, 1, 2
       LIMIT 1000""",
)
def topk_similar_pairs(spark, sf):
    found = similar_vectors(table(spark, sf, "embeddings"), "label", "embedding", "vec_id", -1.1, keep_best=1000)
    return top_pairs(found, "cosine", 1000)


@query(
    "sim_tfidf_bigram",
    """WITH d AS (SELECT lower(company_name) AS t, min(rec_id) AS id, count(*) AS n FROM {entities} GROUP BY 1),
       g AS (SELECT id, n, unnest(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) AS term FROM d),
       tf AS (SELECT id, n, term, count(*) AS tf FROM g GROUP BY ALL),
       df AS (SELECT term, sum(n) AS df FROM tf GROUP BY 1),
       w AS (SELECT id, term, tf * (ln((1 + (SELECT sum(n) FROM d)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)),
       u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w)
       SELECT a.id AS id_left, b.id AS id_right, round(sum(a.w * b.w), 9) AS cosine
       FROM u a JOIN u b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2 HAVING round(sum(a.w * b.w), 9) >= 0.8""",
)
def sim_tfidf_bigram(spark, sf):
    return similar_texts(canopy_names(spark, sf), "name", 0.8, copies="n_records")


# ---------------------------------------------------------------- rules and linkage

_COLS = ["company_name", "industry", "city"]


def _pairs_sql(cols, on, where, sims, distinct="a.company_name <> c.company_name"):
    sides = ", ".join(f"a.{c} AS {c}_left, c.{c} AS {c}_right" for c in cols)
    return (
        _RANKS
        + f""", p AS (SELECT a.rec_id AS id_left, c.rec_id AS id_right, {sides} FROM e a JOIN e c
           ON a.rec_id < c.rec_id AND ({on}) WHERE {distinct}),
           m AS (SELECT *, {sims} FROM p) SELECT * FROM m WHERE {where}"""
    )


def _sims_sql(labels):
    return ", ".join(f"coalesce({_jw(c, 9)}, 0.0) AS {label}" for label, c in labels.items())


_EXACT = ", ".join(f"CAST(coalesce({c}_left = {c}_right, FALSE) AS INT) AS {c}_exact" for c in ("industry", "city"))


@query(
    "rule_band_or_exact",
    _pairs_sql(
        _COLS,
        "a.industry = c.industry OR a.city = c.city OR abs(a.r - c.r) <= 2",
        "(name_sim > 0.8 AND name_sim < 0.92) OR (name_sim > 0.9 AND industry_exact = 1 AND city_exact = 1)",
        _sims_sql({"name_sim": "company_name"}) + ", " + _EXACT,
    ),
)
def rule_band_or_exact(spark, sf):
    rule = mt.band_or_exact("company_name", "industry", "city")
    return mt.link_records(view(spark, sf, "entities"), _COLS, _THREE, rule, "company_name")


@query(
    "rule_band_or_similar",
    _pairs_sql(
        ["company_name", "industry", "country"],
        "a.industry = c.industry OR abs(a.r - c.r) <= 1",
        "(name_sim > 0.8 AND name_sim < 0.92) OR (name_sim > 0.9 AND industry_sim > 0.5 AND country_sim > 0.5)",
        _sims_sql({"name_sim": "company_name", "industry_sim": "industry", "country_sim": "country"}),
    ),
)
def rule_band_or_similar(spark, sf):
    rule = mt.band_or_similar("company_name", "industry", "country")
    indexers = [b.Block("industry"), b.Neighbourhood("company_name", 3)]
    cols = ["company_name", "industry", "country"]
    return mt.link_records(view(spark, sf, "entities"), cols, indexers, rule, "company_name")


_KOFN = ("company_name", "industry", "country", "ownership")


def _zero_sims(cols):
    return ", ".join(
        f"CASE WHEN {c}_left = '' AND {c}_right = '' THEN 0.0 ELSE coalesce({_jw(c, 9)}, 0.0) END AS {c}_similarity"
        for c in cols
    )


@query(
    "rule_k_of_n",
    """WITH f AS (SELECT company_name, coalesce(industry, '') AS industry, country, ownership, min(rec_id) AS id,
                  count(*) AS n FROM {entities} GROUP BY 1, 2, 3, 4),
       e AS (SELECT *, dense_rank() OVER (ORDER BY company_name) AS r FROM f),
       p AS (SELECT a.id AS id_left, c.id AS id_right, a.n AS n_records_left, c.n AS n_records_right, """
    + ", ".join(f"a.{c} AS {c}_left, c.{c} AS {c}_right" for c in _KOFN)
    + """ FROM e a JOIN e c ON a.id < c.id AND abs(a.r - c.r) <= 2), m AS (SELECT *, """
    + _zero_sims(_KOFN)
    + """ FROM p) SELECT * FROM m WHERE company_name_similarity > 0.7 AND country_similarity > 0.75 AND ("""
    + " + ".join(f"CAST({c}_similarity >= 0.75 AS INT)" for c in _KOFN)
    + ") >= 2",
)
def rule_k_of_n(spark, sf):
    # equal names count here, so the result stays on profiles with the records each stands for
    rows = strip_lower(view(spark, sf, "entities").fillna("", ["industry"]), ["company_name"])
    rule = mt.mandatory_and_k_of_n(list(_KOFN), {"company_name": 0.7, "country": 0.75})
    matches, _ = mt.match_profiles(rows, list(_KOFN), [b.Neighbourhood("company_name", 5)], rule)
    return matches


@query(
    "rule_open_band",
    _pairs_sql(
        ["company_name", "country"],
        "abs(a.r - c.r) <= 2",
        "company_name_similarity > 0.7 AND company_name_similarity < 0.9",
        _zero_sims(["company_name", "country"]),
    ),
)
def rule_open_band(spark, sf):
    rule = mt.open_band(["company_name", "country"], "company_name")
    indexers = [b.Neighbourhood("company_name", 5)]
    return mt.link_records(view(spark, sf, "entities"), ["company_name", "country"], indexers, rule, "company_name")


_WCOLS = list(_ROLES.values())
_WSIMS = _sims_sql({f"{r}_sim": c for r, c in _ROLES.items()})
_WSCORE = "round(" + " + ".join(f"{r}_sim * {w}" for r, w in mt.WEIGHTS.items()) + ", 9) AS weighted_score"


def _weighted_sql(on):
    sides = ", ".join(f"a.{c} AS {c}_left, c.{c} AS {c}_right" for c in _WCOLS)
    return f"""SELECT *, {_WSCORE} FROM (SELECT *, {_WSIMS} FROM (SELECT a.rec_id AS id_left, c.rec_id AS id_right, {sides}
        FROM {{entities}} a JOIN {{entities}} c ON a.rec_id < c.rec_id AND {on} WHERE a.company_name <> c.company_name))
        WHERE {_WSCORE.split(' AS ')[0]} > 0.75 AND name_sim > 0.8"""


@query("rule_weighted_floor", _weighted_sql("a.industry = c.industry"))
def rule_weighted_floor(spark, sf):
    rule = mt.weighted_with_floor(_ROLES)
    return mt.link_records(view(spark, sf, "entities"), _WCOLS, [b.Block("industry")], rule, "company_name")


@query(
    "match_per_strategy",
    f"""SELECT *, 'block_by_industry' AS strategy FROM ({_weighted_sql('a.industry = c.industry')})
        UNION ALL SELECT *, 'block_by_city' FROM ({_weighted_sql('a.city = c.city')})""",
)
def match_per_strategy(spark, sf):
    # one linkage for both, each pair named by the strategies that propose it
    strategies = {f"block_by_{col}": [b.Block(col)] for col in ("industry", "city")}
    linked = mt.link_strategies(view(spark, sf, "entities"), _WCOLS, strategies, mt.weighted_with_floor(_ROLES), "company_name")
    return linked.withColumn("strategy", F.explode("strategies")).drop("strategies")


_SETS = {
    "country": [b.Block("country"), b.Neighbourhood("company_name", 5)],
    "city": [b.Block("city"), b.Neighbourhood("company_name", 5)],
}
_SETCOLS = ["company_name", "industry", "country", "city"]


@query(
    "match_multi_set",
    """WITH f AS (SELECT company_name, industry, country, city, min(rec_id) AS id, count(*) AS n FROM {entities} GROUP BY 1, 2, 3, 4),
       e AS (SELECT *, dense_rank() OVER (ORDER BY company_name) AS r FROM f),
       p AS (SELECT a.id AS id_left, c.id AS id_right, a.n AS n_records_left, c.n AS n_records_right,
             coalesce(nullif(a.country, '') = nullif(c.country, ''), FALSE) AS x, coalesce(a.city = c.city, FALSE) AS y, abs(a.r - c.r) <= 2 AS z, """
    + ", ".join(f"a.{c} AS {c}_left, c.{c} AS {c}_right" for c in _SETCOLS)
    + """ FROM e a JOIN e c ON a.id < c.id AND a.company_name <> c.company_name), m AS (SELECT * EXCLUDE (x, y, z), x OR z AS by_country, y OR z AS by_city, """
    + _sims_sql({"name_sim": "company_name", "industry_sim": "industry", "country_sim": "country"})
    + """ FROM p WHERE x OR y OR z) SELECT * FROM m
       WHERE (name_sim > 0.8 AND name_sim < 0.92) OR (name_sim > 0.9 AND industry_sim > 0.5 AND country_sim > 0.5)""",
)
def match_multi_set(spark, sf):
    """Linkage over the union of two blocking sets that share one; profile pairs, and which set proposes each."""
    rule = mt.band_or_similar("company_name", "industry", "country")
    matches, _ = mt.match_strategies(view(spark, sf, "entities"), _SETCOLS, _SETS, rule, "company_name")
    named = {f"by_{name}": F.array_contains("strategies", name) for name in _SETS}
    return matches.withColumns(named).drop("strategies")


@query(
    "linkage_steps",
    """WITH f AS (SELECT company_name, industry, city, min(rec_id) AS id FROM {entities} GROUP BY 1, 2, 3),
       e AS (SELECT *, dense_rank() OVER (ORDER BY company_name) AS r FROM f),
       p AS (SELECT """
    + ", ".join(f"a.{c} AS {c}_left, c.{c} AS {c}_right" for c in _COLS)
    + """ FROM e a JOIN e c ON a.id < c.id AND a.company_name <> c.company_name
             AND (nullif(trim(a.industry), '') = nullif(trim(c.industry), '') OR nullif(trim(a.city), '') = nullif(trim(c.city), '') OR abs(a.r - c.r) <= 2)),
       m AS (SELECT *, """
    + _sims_sql({"name_sim": "company_name"})
    + ", "
    + _EXACT
    + """ FROM p)
       SELECT 'records' AS step, count(*) AS n FROM {entities} UNION ALL SELECT 'profiles', count(*) FROM f
       UNION ALL SELECT 'members', CAST(sum(CAST(trim(industry) <> '' AS INT)) + sum(CAST(trim(city) <> '' AS INT)) + sum(least(r, 3)) AS BIGINT) FROM e
       UNION ALL SELECT 'similar', count(*) FROM m WHERE name_sim > 0.8
       UNION ALL SELECT 'matches', count(*) FROM m WHERE (name_sim > 0.8 AND name_sim < 0.92) OR (name_sim > 0.9 AND industry_exact = 1 AND city_exact = 1)""",
)
def linkage_steps(spark, sf):
    """Rows of every step of a linkage, counted while it runs."""
    rule = mt.band_or_exact("company_name", "industry", "city")
    return mt.linkage_steps(view(spark, sf, "entities"), _COLS, _THREE, rule, "company_name")[1]


@query(
    "match_membership",
    """SELECT min(rec_id) OVER (PARTITION BY company_name, industry, country, city) AS profile, rec_id FROM {entities}""",
)
def match_membership(spark, sf):
    """Which profile every record belongs to: the other half of the matches of profiles."""
    rows = view(spark, sf, "entities")
    return mt.membership(rows, mt.profiles(rows, _SETCOLS), _SETCOLS)


@query(
    "block_given_count",
    """SELECT CAST(count(*) AS BIGINT) AS n_candidates FROM {entities} a JOIN {entities} c
       ON a.rec_id < c.rec_id AND (left(a.company_name, 3) = left(c.company_name, 3) OR a.city = c.city)""",
)
def block_given_count(spark, sf):
    rows = view(spark, sf, "entities")
    given = rows.select("company_name", F.substring("company_name", 1, 3).alias("key"))
    counted = b.candidate_count(rows, [b.Given(given, "company_name"), b.Block("city")])
    return counted.select(F.col("n_candidates").cast("long"))


_EXPORTED = ", ".join(f"a.{c} AS {c}_left, c.{c} AS {c}_right" for c in _COLS)


_EXPORT_SQL = f"""e AS (SELECT *, dense_rank() OVER (ORDER BY company_name) AS r,
          min(rec_id) OVER (PARTITION BY company_name, industry, city) AS pid FROM {{entities}}),
    p AS (SELECT least(a.pid, c.pid) AS id, greatest(a.pid, c.pid) AS other, {_EXPORTED} FROM e a JOIN e c
          ON a.rec_id < c.rec_id AND (a.industry = c.industry OR a.city = c.city OR abs(a.r - c.r) <= 2)),
    m AS (SELECT *, {_sims_sql({"name_sim": "company_name"})}, {_EXACT} FROM p),
    g AS (SELECT id, other, count(*) AS n_pairs FROM m
          WHERE (name_sim > 0.8 AND name_sim < 0.92) OR (name_sim > 0.9 AND industry_exact = 1 AND city_exact = 1) GROUP BY 1, 2),
    x AS (SELECT g.id, x.company_name AS sentence1, y.company_name AS sentence2, '?' AS label, n_pairs
    FROM g JOIN e x ON x.rec_id = g.id JOIN e y ON y.rec_id = g.other)"""


@query("export_blocked_pairs", f"WITH {_EXPORT_SQL} SELECT * FROM x")
def export_blocked_pairs(spark, sf):
    """The sentence pairs for a scorer, written as tab-separated text and read back."""
    rule = mt.band_or_exact("company_name", "industry", "city")
    found = mt.export_blocked_pairs(view(spark, sf, "entities"), _COLS, _THREE, rule, "company_name")
    path = workspace(spark, "blocked") + ".tsv"
    write_pairs(found, path, "gzip")  # pairs outgrow the records, and lines of one record follow each other
    return read_pair_table(spark, path, "id long, sentence1 string, sentence2 string, label string, n_pairs long")


@query(
    "eval_scored_export",
    f"""WITH {_EXPORT_SQL},
    s AS (SELECT DISTINCT least(sentence1, sentence2) AS pair_lo, greatest(sentence1, sentence2) AS pair_hi FROM x
          WHERE jaro_winkler_similarity(lower(sentence1), lower(sentence2)) > 0.88),
    t AS (SELECT least(company_name_left, company_name_right) AS pair_lo, greatest(company_name_left, company_name_right) AS pair_hi, max(label) AS y
          FROM {{entity_pairs}} GROUP BY 1, 2),
    c AS (SELECT count(s.pair_lo) AS n_predicted, count(t.y) AS n_truth, count(*) FILTER (WHERE y = 1) AS n_true,
          count(*) FILTER (WHERE y IS NOT NULL AND s.pair_lo IS NOT NULL) AS n_intersection, count(*) FILTER (WHERE y = 1 AND s.pair_lo IS NOT NULL) AS tp
          FROM t FULL OUTER JOIN s ON t.pair_lo = s.pair_lo AND t.pair_hi = s.pair_hi)
    SELECT *, n_intersection - tp AS fp, n_true - tp AS fn, round(CASE WHEN n_intersection = 0 THEN 0.0 ELSE tp / n_intersection END, 6) AS precision,
           round(CASE WHEN n_true = 0 THEN 0.0 ELSE tp / n_true END, 6) AS recall FROM c""",
)
def eval_scored_export(spark, sf):
    """The exported pairs written, read, scored, those above the threshold taken and held against labelled pairs."""
    scored = score_pairs(export_blocked_pairs(spark, sf), winkler_scorer, threshold=0.88)
    predicted = j.with_pair_key(scored.filter("predicted_label = 1"), "sentence1", "sentence2")
    truth = j.with_pair_key(view(spark, sf, "entity_pairs"), "company_name_left", "company_name_right").select("pair_lo", "pair_hi", "label")
    return evaluate_pairs(predicted, truth).drop("f1").withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query(
    "match_canopy",
    _CANOPIES
    + """, v AS (SELECT canopy, t FROM m JOIN d ON d.id = m.rec_id), x AS (SELECT canopy, f.* FROM v JOIN {entities} f ON lower(f.company_name) = v.t),
    p AS (SELECT DISTINCT a.rec_id AS id_left, c.rec_id AS id_right, """
    + ", ".join(f"a.{c} AS {c}_left, c.{c} AS {c}_right" for c in ("company_name", "industry", "country"))
    + """ FROM x a JOIN x c ON a.canopy = c.canopy AND a.rec_id < c.rec_id WHERE a.company_name <> c.company_name),
    q AS (SELECT *, """
    + _sims_sql({"name_sim": "company_name", "industry_sim": "industry", "country_sim": "country"})
    + """ FROM p) SELECT * FROM q
    WHERE (name_sim > 0.8 AND name_sim < 0.92) OR (name_sim > 0.9 AND industry_sim > 0.5 AND country_sim > 0.5)""",
)
def match_canopy(spark, sf):
    """Linkage with canopies as blocks."""
    rows = view(spark, sf, "entities").withColumn("name", normalize_name("company_name"))
    names = cut_lineage(mt.profiles(rows.select("rec_id", "name"), ["name"]))
    members = canopies(names, "name", copies="n_records").join(names.select("rec_id", "name"), "rec_id")
    given = b.Given(members.select("name", F.col("canopy").cast("string").alias("key")), "name")
    rule = mt.band_or_similar("company_name", "industry", "country")
    cols = ["company_name", "industry", "country", "name"]
    return mt.link_records(rows, cols, [given], rule, "company_name").drop("name_left", "name_right")


@query("gt_candidates")
def gt_candidates(spark, sf):
    """Neighbours in name order from different sources with a middling ratio, every twelfth of the first 2,500."""
    cols = ["rec_id", "company_name", "industry", "country", "_source_table"]
    pairs = b.adjacent_rows(view(spark, sf, "entities"), "company_name", cols=cols)
    ratio = s.sequence_ratio("company_name_left", "company_name_right")
    near = pairs.filter("_source_table_left <> _source_table_right").withColumn("ratio", ratio)
    return every_nth(near.filter("ratio > 0.6 AND ratio < 0.7"), ["rank"], stop_after=2500)


@query(
    "sample_every_nth",
    """WITH p AS (SELECT rec_id AS id_left, lead(rec_id) OVER w AS id_right, _source_table AS s1, lead(_source_table) OVER w AS s2,
                  company_name AS n1, lead(company_name) OVER w AS n2, row_number() OVER w AS rank
                  FROM {entities} WINDOW w AS (ORDER BY company_name, rec_id)),
       q AS (SELECT *, row_number() OVER (ORDER BY rank) AS k FROM p WHERE s1 <> s2
             AND 1 - levenshtein(n1, n2) / greatest(length(n1), length(n2)) > 0.6)
       SELECT id_left, id_right, rank FROM q WHERE k <= 2500 AND (k - 1) % 12 = 0""",
)
def sample_every_nth(spark, sf):
    pairs = b.adjacent_rows(view(spark, sf, "entities"), "company_name", cols=["rec_id", "company_name", "_source_table"])
    likeness = s.levenshtein_similarity(F.col("company_name_left"), F.col("company_name_right"))
    near = pairs.filter("_source_table_left <> _source_table_right").filter(likeness > 0.6)
    return every_nth(near, ["rank"], stop_after=2500).select(
        F.col("rec_id_left").alias("id_left"), F.col("rec_id_right").alias("id_right"), "rank"
    )
