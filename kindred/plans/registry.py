"""Registration of queries, and the input views both engines share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from kindred.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Input views in SQL that Spark and the checking engine read alike. They only shape the given
# tables into the form the operators expect (company records, pairs, sentences).
VIEWS = {
    # company records: many copies of a name, missing and blank values, five sources
    "entities": """
        SELECT p_partkey AS rec_id,
               CASE WHEN h < '4' THEN p_name ELSE p_name || ' ' || substr(h, 2, 3) END AS company_name,
               CASE WHEN substr(h, 5, 1) >= '2' THEN lower(p_type) || ' ' || CAST(p_size AS STRING) END AS industry,
               p_brand || '-' || CAST(p_size AS STRING) AS city,
               CASE WHEN substr(h, 6, 1) >= '2' THEN lower(p_brand) ELSE '' END AS country,
               p_type AS ownership,
               'source ' || substr(h, 7, 1) AS _source_table
        FROM (SELECT *, md5(CAST(p_partkey AS STRING)) AS h FROM {part}) p""",
    # the same records as raw text: missing, blank, padded, upper case, punctuation, lists
    "dirty": """
        SELECT p_partkey AS rec_id,
               CASE substr(h, 1, 1) WHEN '0' THEN NULL WHEN '1' THEN '' WHEN '2' THEN '  '
                    WHEN '3' THEN chr(9) || upper(p_name) || ' ' || chr(10) WHEN '4' THEN p_name || ',  Inc.'
                    WHEN '5' THEN '[' || chr(39) || p_name || chr(39) || ', ' || chr(39) || p_brand || chr(39) || ']'
                    WHEN '6' THEN 'nan' WHEN '7' THEN p_name || '; ' || lower(p_brand) || '; ' || p_type
                    ELSE p_name || ' ' || substr(h, 2, 3) END AS raw_name,
               CASE WHEN substr(h, 5, 1) >= '4' THEN p_type END AS raw_type,
               CASE WHEN substr(h, 6, 1) >= '4' THEN ' ' || p_brand || ' ' ELSE '' END AS raw_brand,
               p_size AS size
        FROM (SELECT *, md5(CAST(p_partkey AS STRING)) AS h FROM {part}) p""",
    # labelled and scored id pairs: the parts with the smallest and largest key of every order
    "pairs": """
        SELECT l_orderkey AS id, min(l_partkey) AS ltable_id, max(l_partkey) AS rtable_id,
               CAST(CASE WHEN sum(l_quantity) > 180 THEN 1 ELSE 0 END AS INT) AS label,
               round(avg(l_discount) * 10, 4) AS score
        FROM {lineitem} l GROUP BY l_orderkey""",
    "named_pairs": """
        SELECT q.id, q.ltable_id, q.rtable_id, q.label, q.score, a.p_name AS name_left, b.p_name AS name_right,
               CAST(CASE WHEN q.score >= 0.5 THEN 1 ELSE 0 END AS INT) AS prediction
        FROM {pairs} q JOIN {part} a ON a.p_partkey = q.ltable_id JOIN {part} b ON b.p_partkey = q.rtable_id""",
    "entity_pairs": """
        SELECT q.id, q.label, q.score,
               a.company_name AS company_name_left, b.company_name AS company_name_right,
               a.industry AS industry_left, b.industry AS industry_right,
               a.city AS city_left, b.city AS city_right, a.country AS country_left, b.country AS country_right,
               a.ownership AS ownership_left, b.ownership AS ownership_right,
               a._source_table AS source_left, b._source_table AS source_right
        FROM {pairs} q JOIN {entities} a ON a.rec_id = q.ltable_id JOIN {entities} b ON b.rec_id = q.rtable_id""",
    # question and answer of every two turns that follow each other
    "turns": """
        SELECT CAST(a.conv_id * 100 + a.turn AS BIGINT) AS id, a.text AS text_a, b.text AS text_b,
               CASE WHEN a.role = 'user' THEN '1' ELSE '0' END AS label
        FROM {conversations} a JOIN {conversations} b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
    # two sources with columns of their own for the schema mapping
    "market": """
        SELECT CAST(c_custkey AS STRING) AS `id`, c_name AS ` Name `, c_mktsegment AS `Area of Activity`,
               n_name || ',  ' || c_mktsegment || ' ,, ' || c_name AS `locations`,
               CAST(CAST(1950 + c_nationkey AS DOUBLE) AS STRING) || ' (old)' AS `Founded.Year`,
               CASE WHEN c_acctbal > 0 THEN lower(c_mktsegment) END AS `web`,
               CASE WHEN c_acctbal > 5000 THEN '@' || c_name END AS `social`
        FROM {customer} c JOIN {nation} n ON n_nationkey = c_nationkey""",
    "vendors": """
        SELECT CAST(s_suppkey AS STRING) AS `id`, s_name AS `name`,
               CASE WHEN s_acctbal > 1000 THEN n_name END AS `country`, n_name || '|' || s_name AS `address`
        FROM {supplier} s JOIN {nation} n ON n_nationkey = s_nationkey""",
}


def _needs(sql: str) -> list[str]:
    return [n for n in [*VIEWS, *TABLES] if "{" + n + "}" in sql]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table, or a view over given tables, as a DataFrame."""
    if name not in VIEWS:
        return table(spark, sf, name)
    return run_sql(spark, sf, VIEWS[name])


def run_sql(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{n: view(spark, sf, n) for n in _needs(sql)})


def oracle(sql: str) -> str:
    """SQL with the views it names put in front."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _needs(text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    named = [f"{n} AS ({VIEWS[n]})" for n in order]
    body, head = sql.strip(), "WITH "
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            body, head = body[len(start) :], start
            named.append("")
            break
    if not named:
        named_text = body
    else:
        own = named[-1] == ""
        named_text = head + (", ".join(named) if own else ", ".join(named) + " ") + body
    for n in [*VIEWS, *TABLES]:
        named_text = named_text.replace("{" + n + "}", n)
    return named_text.replace("`", '"')


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its twin over the given tables."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @wraps(build)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return build(ship_package(spark), sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return build

    return register
