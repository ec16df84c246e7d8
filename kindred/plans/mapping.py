"""Schema-mapping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.operators import mapping as m
from kindred.plans.registry import query, run_sql, view
from kindred.session import workspace
from kindred.sources.readers import catalog


def _mapped(spark, sf, source, **attributes):
    spec = m.parse_spec({"rec_key": [f"{source}.id"], **attributes})
    return m.transform_table(view(spark, sf, source), source, spec)


_TOKENS = (
    "list_filter(list_transform(string_split(regexp_replace({c}, '\\s+', ' ', 'g'), '{d}'), lambda x: trim(x)), "
    "lambda x: x <> '')"
)
_LOCATIONS = _TOKENS.format(c="locations", d=",")


@query(
    "map_one_to_one",
    """SELECT id AS rec_key, ` Name ` AS company_name,
       CASE WHEN web IS NULL THEN `Area of Activity` ELSE web || ' / ' || `Area of Activity` END AS industry,
       CAST(NULL AS VARCHAR) AS ownership, 'market' AS _source_table FROM {market}""",
)
def map_one_to_one(spark, sf):
    return _mapped(
        spark, sf, "market",
        company_name=["market.Name", "vendors.name", "nodot"],
        industry={"sources": ["market.web", "market.Area of Activity"], "relation": "one-to-one", "merge_delimiter": " / "},
        ownership=["market.Owner"],
    )


@query(
    "map_many_to_one",
    """SELECT id AS rec_key, CASE WHEN web IS NULL AND social IS NULL THEN NULL ELSE concat_ws(';', web, social) END
       AS social_media_links, 'market' AS _source_table FROM {market}""",
)
def map_many_to_one(spark, sf):
    links = {"sources": ["market.web", "market.social"], "relation": "many-to-one", "merge_delimiter": ";"}
    return _mapped(spark, sf, "market", social_media_links=links)


@query(
    "map_one_to_many",
    f"""SELECT id AS rec_key, array_to_string({_LOCATIONS}, '#') AS places, len({_LOCATIONS}) AS n_places,
        'market' AS _source_table FROM {{market}}""",
)
def map_one_to_many(spark, sf):
    places = {"sources": ["market.locations"], "relation": "one-to-many", "split_delimiter": ","}
    out = _mapped(spark, sf, "market", places=places)
    return out.withColumns({"n_places": F.size("places").cast("long"), "places": F.array_join("places", "#")})


@query(
    "map_take_index",
    f"""SELECT id AS rec_key, ({_LOCATIONS})[2] AS city, ({_LOCATIONS})[6] AS beyond, CAST(NULL AS VARCHAR) AS below,
        'market' AS _source_table FROM {{market}}""",
)
def map_take_index(spark, sf):
    base = {"sources": ["market.locations"], "relation": "one-to-many", "split_delimiter": ",", "take_first": True}
    return _mapped(
        spark, sf, "market",
        city={**base, "take_index": 1}, beyond={**base, "take_index": 5}, below={**base, "take_index": -1},
    )


@query(
    "map_take_first",
    "SELECT id AS rec_key, string_split(`Founded.Year`, ' ')[1] AS year_founded, 'market' AS _source_table FROM {market}",
)
def map_take_first(spark, sf):
    year = {"sources": ["market.Founded.Year"], "relation": "one-to-many", "split_delimiter": " ", "take_first": True}
    return _mapped(spark, sf, "market", year_founded=year)


@query(
    "map_split_fallback",
    """SELECT id AS rec_key, CASE WHEN web IS NULL AND social IS NULL THEN NULL ELSE concat_ws(' ', web, social) END
       AS links, 'market' AS _source_table FROM {market}""",
)
def map_split_fallback(spark, sf):
    return _mapped(spark, sf, "market", links={"sources": ["market.web", "market.social"], "relation": "one-to-many"})


@query(
    "map_unknown_relation",
    "SELECT id AS rec_key, coalesce(web, social) AS link, 'market' AS _source_table FROM {market}",
)
def map_unknown_relation(spark, sf):
    return _mapped(spark, sf, "market", link={"sources": ["market.web", "market.social"], "relation": "any"})


_RULES = {
    "sources": ["market.locations", "vendors.address"],
    "relation": "one-to-one",
    "split_delimiter": ",",
    "table_rules": {
        "market": {"relation": "one-to-many", "take_index": 0},
        "vendors": {"relation": "one-to-many", "split_delimiter": "|", "take_index": 1},
    },
}


@query(
    "map_table_rules",
    f"""SELECT id AS rec_key, ({_LOCATIONS})[1] AS place, 'market' AS _source_table FROM {{market}}
        UNION ALL SELECT id, string_split(address, '|')[2], 'vendors' FROM {{vendors}}""",
)
def map_table_rules(spark, sf):
    spec = m.parse_spec({"rec_key": ["market.id", "vendors.id"], "place": _RULES})
    return m.populate(spark, {n: view(spark, sf, n) for n in ("market", "vendors")}, spec)


# a target schema over both sources
SPEC = {
    "rec_key": ["market.id", "vendors.id"],
    "company_name": {"sources": ["market.Name", "vendors.name"], "relation": "one-to-one"},
    "industry": ["market.Area of Activity"],
    "headquarters_country": {
        "sources": ["market.locations", "vendors.country"],
        "relation": "one-to-one",
        "table_rules": {"market": {"relation": "one-to-many", "split_delimiter": ",", "take_index": 0}},
    },
    "social_media_links": {"sources": ["market.web", "market.social"], "relation": "many-to-one", "merge_delimiter": ";"},
    "year_founded": {
        "sources": ["market.Founded.Year"],
        "table_rules": {"market": {"relation": "one-to-many", "split_delimiter": " ", "take_first": True}},
    },
    "unmapped": 7,
}

_MARKET_ROWS = f"""SELECT id AS rec_key, ` Name ` AS company_name, `Area of Activity` AS industry,
    ({_LOCATIONS})[1] AS headquarters_country,
    CASE WHEN web IS NULL AND social IS NULL THEN NULL ELSE concat_ws(';', web, social) END AS social_media_links,
    string_split(`Founded.Year`, ' ')[1] AS year_founded, CAST(NULL AS VARCHAR) AS unmapped,
    'market' AS _source_table FROM {{market}}"""


@query("map_transform_table", _MARKET_ROWS)
def map_transform_table(spark, sf):
    return m.transform_table(view(spark, sf, "market"), "market", m.parse_spec(SPEC))


@query(
    "map_populate_union",
    _MARKET_ROWS + " UNION ALL SELECT id, name, NULL, country, NULL, NULL, NULL, 'vendors' FROM {vendors}",
)
def map_populate_union(spark, sf):
    return m.populate(spark, {n: view(spark, sf, n) for n in ("vendors", "market")}, m.parse_spec(SPEC))


_DOCUMENT_ROWS = """
    SELECT `attribute`, `table`, `column` FROM (
        SELECT 'name ' || p_name AS `attribute`, p_brand AS `table`, p_type || '.' || CAST(p_size AS STRING) AS `column`
        FROM {part}
        UNION ALL SELECT 'key', 'part', CAST(p_partkey AS STRING) FROM {part}) x"""


@query("mapping_doc_explode", _DOCUMENT_ROWS)
def mapping_doc_explode(spark, sf):
    documents = run_sql(
        spark,
        sf,
        """SELECT '```json' || chr(10) || to_json(map(
                  'name ' || p_name, array(p_brand || '.' || p_type || '.' || CAST(p_size AS STRING)),
                  'key', array('part.' || CAST(p_partkey AS STRING), 'without a table')))
                  || chr(10) || '```' AS document FROM {part}""",
    )
    return m.mapping_rows(documents)


_MARKET = ["id", " Name ", "Area of Activity", "locations", "Founded.Year", "web", "social"]
_VENDORS = ["id", "name", "country", "address"]


def _counted(name, columns):
    return " UNION ALL ".join(f"SELECT '{name}' AS `table`, '{c.strip()}' AS `column`, count(`{c}`) AS n_values FROM {{{name}}}" for c in columns)


@query(
    "mapping_coverage",
    f"""WITH known AS ({_counted("market", _MARKET)} UNION ALL {_counted("vendors", _VENDORS)}),
       refs AS (SELECT * FROM (VALUES ('market', 'Name', 'company_name'), ('vendors', 'name', 'company_name'),
         ('market', 'web', 'contact,site'), ('vendors', 'phone', 'phone')) r(`table`, `column`, attributes))
       SELECT coalesce(k.`table`, r.`table`) AS `table`, coalesce(k.`column`, r.`column`) AS `column`,
         CASE WHEN r.`table` IS NULL THEN 'unused' WHEN k.`table` IS NULL THEN 'dangling' ELSE 'used' END AS status,
         coalesce(r.attributes, '') AS attributes, coalesce(n_values, 0) AS n_values
       FROM known k FULL OUTER JOIN refs r ON k.`table` = r.`table` AND k.`column` = r.`column`""",
)
def mapping_coverage(spark, sf):
    spec = m.parse_spec(
        {"company_name": ["market.Name", "vendors.name"], "site": ["market.web"], "contact": ["market.web"], "phone": ["vendors.phone"]}
    )
    tables = {n: view(spark, sf, n) for n in ("market", "vendors")}
    return m.coverage(catalog(tables), m.spec_rows(spark, spec))


@query(
    "map_write_per_source",
    """SELECT 'market' AS _source_table, c_name AS name, c_mktsegment AS area FROM {customer}
       UNION ALL SELECT 'vendors', s_name, NULL FROM {supplier}""",
)
def map_write_per_source(spark, sf):
    """The mediated table, written in one folder per source and read back."""
    spec = m.parse_spec({"name": ["market.Name", "vendors.name"], "area": ["market.Area of Activity"]})
    path = workspace(spark, "mediated")
    m.write_mediated(m.populate(spark, {n: view(spark, sf, n) for n in ("market", "vendors")}, spec), path)
    return spark.read.parquet(path).select("_source_table", "name", "area")
