"""Cleaning, list and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.functions import cleaning as c
from kindred.operators import text as t
from kindred.operators import truth as g
from kindred.plans.registry import query, view
from kindred.session import workspace

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def strip_sql(col: str) -> str:
    return _STRIP.format(col)


@query(
    "clean_fill_empty",
    """SELECT rec_id, coalesce(raw_name, '') AS raw_name, coalesce(raw_type, '') AS raw_type, raw_brand,
       CAST(size AS VARCHAR) AS size FROM {dirty}""",
)
def clean_fill_empty(spark, sf):
    return c.fill_empty(view(spark, sf, "dirty"), ["raw_name", "raw_type", "raw_brand", "size"])


@query("clean_dropna_key", "SELECT * FROM {dirty} WHERE raw_name IS NOT NULL AND raw_type IS NOT NULL")
def clean_dropna_key(spark, sf):
    return c.drop_null_key(view(spark, sf, "dirty"), "raw_name", "raw_type")


@query(
    "clean_strip_lower",
    f"""SELECT rec_id, lower({strip_sql('raw_name')}) AS raw_name, lower({strip_sql('raw_type')}) AS raw_type,
        lower({strip_sql('raw_brand')}) AS raw_brand, size FROM {{dirty}}""",
)
def clean_strip_lower(spark, sf):
    return c.strip_lower(view(spark, sf, "dirty"))


@query("clean_drop_blank", f"SELECT rec_id, raw_name FROM {{dirty}} WHERE {strip_sql('raw_name')} <> ''")
def clean_drop_blank(spark, sf):
    return c.drop_blank(view(spark, sf, "dirty").select("rec_id", "raw_name"), "raw_name")


@query("norm_name", f"SELECT rec_id, lower({strip_sql(chr(99)+'oalesce(raw_name, '+chr(39)+'nan'+chr(39)+')')}) AS name FROM {{dirty}}")
def norm_name(spark, sf):
    return view(spark, sf, "dirty").select("rec_id", c.normalize_name("raw_name").alias("name"))


_BARE = r"regexp_replace(lower(raw_name), '[^\w\s]', '', 'g')"


@query(
    "norm_company",
    f"""SELECT rec_id, coalesce({strip_sql("regexp_replace(" + _BARE + r", '\s+', ' ', 'g')")}, '') AS name
        FROM {{dirty}}""",
)
def norm_company(spark, sf):
    return view(spark, sf, "dirty").select("rec_id", c.normalize_company_name("raw_name").alias("name"))


@query(
    "pair_key",
    "SELECT id, least(name_left, name_right) AS pair_lo, greatest(name_left, name_right) AS pair_hi FROM {named_pairs}",
)
def pair_key(spark, sf):
    return view(spark, sf, "named_pairs").select("id", *c.pair_key("name_left", "name_right"))


_LISTS = "CASE WHEN raw_type IS NOT NULL THEN [raw_type, raw_brand, CAST(size AS VARCHAR)] END"


def _lists(spark, sf):
    rows = view(spark, sf, "dirty")
    items = F.array("raw_type", "raw_brand", F.col("size").cast("string"))
    return rows.select("rec_id", F.when(F.col("raw_type").isNotNull(), items).alias("items"))


@query("list_join", f"SELECT rec_id, coalesce(array_to_string({_LISTS}, '; '), '') AS text FROM {{dirty}}")
def list_join(spark, sf):
    return _lists(spark, sf).select("rec_id", c.join_list("items").alias("text"))


@query(
    "list_split",
    "SELECT rec_id, len(x) AS n_items, x[1] AS head, x[len(x)] AS tail "
    "FROM (SELECT rec_id, string_split(raw_name, '; ') AS x FROM {dirty})",
)
def list_split(spark, sf):
    parts = view(spark, sf, "dirty").select("rec_id", c.split_list("raw_name").alias("x"))
    size = F.when(F.col("x").isNotNull(), F.size("x")).cast("long")
    return parts.select("rec_id", size.alias("n_items"), F.get("x", F.lit(0)).alias("head"), F.element_at("x", -1).alias("tail"))


@query(
    "list_quote_pipe",
    f"""SELECT rec_id, coalesce(array_to_string(list_transform({_LISTS}, lambda x: chr(39) || x || chr(39)), '|'),
        'Unknown') AS text FROM {{dirty}}""",
)
def list_quote_pipe(spark, sf):
    return _lists(spark, sf).select("rec_id", c.quote_list("items").alias("text"))


@query(
    "parse_list_literal",
    """SELECT rec_id, CASE WHEN raw_name IS NULL OR raw_name = 'nan' THEN NULL
        WHEN starts_with(raw_name, '[') THEN array_to_string(string_split(replace(raw_name[2:-2], chr(39), ''), ', '), '#')
        ELSE raw_name END AS items,
       CASE WHEN raw_name IS NULL OR raw_name = 'nan' THEN NULL WHEN starts_with(raw_name, '[') THEN 2 ELSE 1 END AS n_items
       FROM {dirty}""",
)
def parse_list_literal(spark, sf):
    rows = view(spark, sf, "dirty").select("rec_id", c.parse_list_literal("raw_name").alias("x"))
    size = F.when(F.col("x").isNotNull(), F.size("x"))
    return rows.select("rec_id", F.array_join("x", "#").alias("items"), size.alias("n_items"))


@query(
    "text_key_concat",
    "SELECT rec_id, coalesce(raw_name, 'nan') || '|' || coalesce(raw_type, 'nan') AS text FROM {dirty}",
)
def text_key_concat(spark, sf):
    return view(spark, sf, "dirty").select("rec_id", c.match_text("raw_name", "raw_type").alias("text"))


@query(
    "coalesce_unknown",
    """SELECT rec_id, coalesce(nullif(raw_type, ''), nullif(raw_brand, ''), 'UNKNOWN') AS name,
       coalesce(nullif(raw_type, ''), nullif(raw_brand, '')) IS NULL AS is_missing FROM {dirty}""",
)
def coalesce_unknown(spark, sf):
    name = c.first_filled("raw_type", "raw_brand")
    return view(spark, sf, "dirty").select("rec_id", name.alias("name")).withColumn(
        "is_missing", F.col("name") == "UNKNOWN"
    )


@query(
    "reorder_label_first",
    "SELECT quality AS label, d.doc_id, lang, n_chars FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id",
)
def reorder_label_first(spark, sf):
    marked = view(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(
        view(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "left"
    )
    return c.label_first(marked)


_TAG = "'COL company_name VAL ' || company_name_{s} || ' COL company_sector VAL ' || coalesce(industry_{s}, 'Unknown') || ' COL company_country VAL ' || country_{s}"


@query(
    "text_tagged_pair",
    f"""SELECT id, {_TAG.format(s='left')} || chr(32) || chr(9) || chr(32) || {_TAG.format(s='right')}
        || chr(32) || chr(9) || chr(32) || CAST(label AS VARCHAR) AS line FROM {{entity_pairs}}""",
)
def text_tagged_pair(spark, sf):
    def side(s):
        return t.tagged(
            {
                "company_name": F.col(f"company_name_{s}"),
                "company_sector": c.quote_list_text(f"industry_{s}"),
                "company_country": c.quote_list_text(f"country_{s}"),
            }
        )

    return view(spark, sf, "entity_pairs").select(
        "id", t.tagged_line(side("left"), side("right"), F.col("label")).alias("line")
    )


@query(
    "text_full_join",
    "SELECT rec_id, concat_ws(' ', raw_name, raw_type, raw_brand, CAST(size AS VARCHAR)) AS text FROM {dirty}",
)
def text_full_join(spark, sf):
    rows = view(spark, sf, "dirty")
    return rows.select("rec_id", t.all_but_first(rows, "rec_id").alias("text"))


@query(
    "text_fallback_join",
    """SELECT p_partkey AS rec_id, CASE WHEN raw_type IS NULL THEN p_name ELSE p_name || ' ' || raw_type END AS text
       FROM {part} JOIN {dirty} ON rec_id = p_partkey""",
)
def text_fallback_join(spark, sf):
    rows = view(spark, sf, "dirty").join(
        view(spark, sf, "part").select(F.col("p_partkey").alias("rec_id"), "p_name"), "rec_id"
    )
    return rows.select("rec_id", t.with_fallback("p_name", "raw_type").alias("text"))


@query(
    "text_dash_join",
    """SELECT rec_id, coalesce(raw_name, '') || ' - ' || coalesce(raw_type, '') || ' - ' || coalesce(raw_brand, '') AS text
       FROM {dirty}""",
)
def text_dash_join(spark, sf):
    return view(spark, sf, "dirty").select("rec_id", t.dash_joined("raw_name", "raw_type", "raw_brand").alias("text"))


def truth_documents(spark, sf):
    """One JSON document per labelled pair; positives spell the name key with a dash and list industries."""
    pairs = view(spark, sf, "entity_pairs")

    def side(s, positive):
        fields = [
            F.col(f"company_name_{s}").alias("company-name" if positive else "company_name"),
            (F.array(F.col(f"industry_{s}"), F.col(f"ownership_{s}")) if positive else F.col(f"industry_{s}")).alias("industry"),
            F.col(f"country_{s}").alias("country"),
            F.col(f"source_{s}").alias("source"),
        ]
        return F.struct(*fields)

    def document(positive):
        record = F.struct(
            F.array(side("left", positive), side("right", positive)).alias("pairs"), F.lit(positive).alias("match")
        )
        return F.to_json(F.struct(F.array(record).alias("ground_truth")))

    return pairs.select(F.when(F.col("label") == 1, document(True)).otherwise(document(False)).alias("document"))


_FLAT = """SELECT company_name_left AS company_a,
    CASE WHEN label = 1 THEN array_to_string(list_filter([industry_left, ownership_left], lambda x: x IS NOT NULL), '; ')
         ELSE coalesce(industry_left, '') END AS industry_a, country_left AS country_a, source_left AS source_a,
    company_name_right AS company_b,
    CASE WHEN label = 1 THEN array_to_string(list_filter([industry_right, ownership_right], lambda x: x IS NOT NULL), '; ')
         ELSE coalesce(industry_right, '') END AS industry_b, country_right AS country_b, source_right AS source_b, label
    FROM {entity_pairs}"""


@query("gt_flatten", _FLAT)
def gt_flatten(spark, sf):
    return g.flatten_truth(truth_documents(spark, sf))


_SIDE = """{{'company-name': company_{s}, 'industry': string_split(industry_{s}, '; '), 'country': country_{s},
 'source': source_{s}}}"""


@query(
    "gt_nested_export",
    f"""SELECT CAST(to_json([{_SIDE.format(s='a')}, {_SIDE.format(s='b')}]) AS VARCHAR) AS pairs, label = 1 AS is_match
        FROM ({_FLAT})""",
)
def gt_nested_export(spark, sf):
    nested = g.nested_truth(g.flatten_truth(truth_documents(spark, sf)))
    return nested.select(F.to_json("pairs").alias("pairs"), F.col("match").alias("is_match"))


@query("gt_nested_file", _FLAT)
def gt_nested_file(spark, sf):
    """The nested truth written as JSON documents, read again and flattened."""
    path = workspace(spark, "truth")
    g.write_truth(g.nested_truth(g.flatten_truth(truth_documents(spark, sf))), path)
    return g.read_truth(spark, path)
