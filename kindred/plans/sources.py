"""Source and sink queries: the given tables are written out and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.operators.joins import lookup_pairs
from kindred.plans.registry import query, table, view
from kindred.session import workspace
from kindred.sources import readers as r
from kindred.sources import writers as w


@query(
    "src_multi_format",
    """SELECT 'customer' AS source, CAST(c_custkey AS VARCHAR) AS rec_key, c_name AS name,
              CAST(c_nationkey AS VARCHAR) AS nation FROM {customer}
       UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR) FROM {supplier}
       UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_name, p_brand FROM {part}""",
)
def src_multi_format(spark, sf):
    folder = workspace(spark, "mixed") + "/same/same"  # a folder named like its parent
    customer = table(spark, sf, "customer")
    w.write_csv(customer.where("c_custkey % 3 = 0"), f"{folder}/customer.csv")  # one name, three files
    w.write_json_lines(customer.where("c_custkey % 3 = 1"), f"{folder}/customer.json")
    w.write_json_lines(customer.where("c_custkey % 3 = 2").drop("c_acctbal"), f"{folder}/customer.jsonl")
    w.write_json_lines(table(spark, sf, "supplier"), f"{folder}/supplier.jsonl")
    w.write_json_lines(table(spark, sf, "part"), f"{folder}/part.v2.json.json")  # second dot: unknown format "v2"
    w.write_json_lines(table(spark, sf, "part"), f"{folder}/part.json")
    table(spark, sf, "nation").select("n_name").write.text(f"{folder}/broken.json")
    table(spark, sf, "nation").select("n_name").write.text(f"{folder}/noext")
    found = r.read_folder(spark, folder)
    if {n: len(t) for n, t in found.tables.items()} != {"customer": 3, "supplier": 1, "part": 1}:
        raise AssertionError(f"unexpected tables {sorted(found.tables)}, left out {found.skipped}")
    wanted = {
        "customer": ("c_custkey", "c_name", "c_nationkey"),
        "supplier": ("s_suppkey", "s_name", "s_nationkey"),
        "part": ("p_partkey", "p_name", "p_brand"),
    }
    parts = [
        found.table(t).select(
            F.lit(t).alias("source"), F.col(key).alias("rec_key"), F.col(name).alias("name"), F.col(n).alias("nation")
        )
        for t, (key, name, n) in wanted.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("src_drop_index", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_type FROM {part}")
def src_drop_index(spark, sf):
    path = workspace(spark, "indexed") + ".csv"
    part = table(spark, sf, "part")
    w.write_csv(part.select(F.col("p_partkey").alias("Unnamed: 0"), "p_partkey", "p_name", "p_type"), path)
    return r.read_table(spark, path, "csv")


@query("src_project_scan", "SELECT o_orderkey, o_orderpriority FROM {orders}")
def src_project_scan(spark, sf):
    path = workspace(spark, "orders") + ".tsv"
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    w.write_csv(table(spark, sf, "orders").select(*cols), path, sep="\t")
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
    return r.read_columns(spark, path, schema, ["o_orderkey", "o_orderpriority"], sep="\t")


@query("proj_available", "SELECT c_name, c_nationkey FROM {customer}")
def proj_available(spark, sf):
    return r.available(table(spark, sf, "customer"), ["c_name", "industry", "c_nationkey", "ownership"])


def _turn_lines(spark, sf):
    """Turn pairs as single lines: tabs and line ends in the texts become spaces."""
    flat = lambda c: F.regexp_replace(c, "[\\t\\r\\n]+", " ").alias(c)
    return view(spark, sf, "turns").select("id", flat("text_a"), flat("text_b"), "label")


_FLAT_TEXT = "regexp_replace({}, '[\\t\\r\\n]+', ' ', 'g')"
_TURN_ROWS = f"""SELECT '{{g}}-' || {{id}} AS guid, {_FLAT_TEXT.format('text_a')} AS text_a,
    {_FLAT_TEXT.format('text_b')} AS text_b, label, '{{s}}' AS split FROM {{{{turns}}}}"""
_NAMED_ID = "CASE WHEN id % 7 = 0 THEN 'id' ELSE CAST(id AS VARCHAR) END"  # ids that read like a header


@query(
    "src_pairs_4col",
    _TURN_ROWS.format(g="train", s="train", id=_NAMED_ID) + " UNION ALL " + _TURN_ROWS.format(g="test", s="test", id=_NAMED_ID),
)
def src_pairs_4col(spark, sf):
    path = workspace(spark, "pairs")
    name = F.when(F.col("id") % 7 == 0, F.lit("id")).otherwise(F.col("id").cast("string"))
    rows = _turn_lines(spark, sf).select(name.alias("pair"), "text_a", "text_b", "label")  # a header of its own
    w.write_pairs(rows, f"{path}/train")
    return r.read_splits(spark, {"train": f"{path}/train", "test": f"{path}/train"}, escaped=True)


@query(
    "sink_pairs_dirty",
    """SELECT rec_id, CASE rec_id % 7 WHEN 0 THEN raw_name || chr(9) || 'x' || chr(10) || 'y' WHEN 1 THEN '' WHEN 2 THEN NULL
              WHEN 3 THEN chr(92) || 't' || raw_name || chr(92) WHEN 4 THEN chr(13) || raw_name || '"' || chr(39) ELSE raw_name END AS sentence1,
              raw_type || chr(92) || chr(92) || 'n' || chr(92) || chr(9) AS sentence2, size FROM {dirty}""",
)
def sink_pairs_dirty(spark, sf):
    """Tabs, line breaks, quotes, backslashes, empty and missing texts survive a pair file."""
    path = workspace(spark, "dirty-pairs")
    name, kind = F.col("raw_name"), F.col("rec_id") % 7
    odd = (
        F.when(kind == 0, F.concat(name, F.lit("\tx\ny"))).when(kind == 1, F.lit("")).when(kind == 2, F.lit(None))
        .when(kind == 3, F.concat(F.lit("\\t"), name, F.lit("\\"))).when(kind == 4, F.concat(F.lit("\r"), name, F.lit("\"'"))).otherwise(name)
    )
    rows = view(spark, sf, "dirty").select(
        "rec_id", odd.alias("sentence1"), F.concat("raw_type", F.lit("\\\\n\\\t")).alias("sentence2"), "size"
    )
    w.write_pairs(rows, path)
    kinds = dict(rows.dtypes)
    return r.read_pair_table(spark, path, ", ".join(f"{c} {kinds[c]}" for c in rows.columns))


@query(
    "src_pair_rejects",
    f"""SELECT CAST(id AS VARCHAR) || chr(9) || {_FLAT_TEXT.format('text_a')} AS value, 2 AS n_fields, 'pairs' AS source
            FROM {{turns}} WHERE id % 3 = 0
        UNION ALL SELECT {_FLAT_TEXT.format('text_a')}, 1, 'matches' FROM {{turns}} WHERE id % 3 = 1""",
)
def src_pair_rejects(spark, sf):
    """Lines the pair and match-text readers cannot use are reported, not lost."""
    path = workspace(spark, "rejects")
    rows = _turn_lines(spark, sf)
    good = rows.where("id % 3 <> 0").select(F.concat_ws("\t", "id", "text_a", "text_b", "label").alias("value"))
    short = rows.where("id % 3 = 0").select(F.concat_ws("\t", "id", "text_a").alias("value"))
    # one header line per file: the file is written as text, header first
    lines = good.unionByName(short).sortWithinPartitions("value")
    headed = lines.mapInPandas(_with_header, "value string")
    headed.write.text(f"{path}/pairs")
    pairs = r.rejected_pairs(spark, f"{path}/pairs").withColumn("source", F.lit("pairs"))
    side = F.concat_ws(" | ", "text_a", "label")
    texts = rows.select(F.when(F.col("id") % 3 == 1, F.col("text_a")).otherwise(F.concat_ws(" \t ", side, side, "label")).alias("value"))
    texts.write.text(f"{path}/matches")
    matches = r.rejected_match_text(spark.read.text(f"{path}/matches")).withColumn("source", F.lit("matches"))
    return pairs.unionByName(matches)


def _with_header(batches):
    import pandas as pd

    yield pd.DataFrame({"value": ["id\tsentence1\tsentence2\tlabel"]})
    yield from batches


@query(
    "src_pairs_6col",
    " UNION ALL ".join(
        _TURN_ROWS.format(g=g, s=s, id="CAST(id AS VARCHAR)") for g, s in (("train", "train"), ("dev", "dev"), ("dev", "test"))
    ),
)
def src_pairs_6col(spark, sf):
    path = workspace(spark, "questions")
    rows = _turn_lines(spark, sf).select(
        "id", F.col("id").alias("qid1"), F.col("id").alias("qid2"), F.col("text_a").alias("question1"),
        F.col("text_b").alias("question2"), F.col("label").alias("is_duplicate"),
    )
    w.write_pairs(rows, f"{path}/dev")
    # the test file has no labels: the dev file stands in for it
    w.write_pairs(rows.select("id", "question1", "question2"), f"{path}/test")
    return r.read_splits(spark, {"train": f"{path}/dev", "dev": f"{path}/dev", "test": f"{path}/test"}, layout=6, escaped=True)


@query(
    "parse_match_text",
    """SELECT company_name_left, coalesce(industry_left, '') AS industry_left, country_left, company_name_right,
       coalesce(industry_right, '') AS industry_right, country_right FROM {entity_pairs}""",
)
def parse_match_text(spark, sf):
    path = workspace(spark, "matches")
    side = lambda s: F.concat_ws(" | ", *[F.coalesce(f"{c}_{s}", F.lit("")) for c in ("company_name", "industry", "country")])
    lines = F.concat_ws(" \t ", side("left"), side("right"), F.col("score").cast("string"))
    view(spark, sf, "entity_pairs").select(lines.alias("value")).write.text(path)
    return r.parse_match_text(spark.read.text(path), ["company_name", "industry", "country"])


@query(
    "sink_roundtrip",
    """SELECT 'csv' AS format, rec_id, nullif(raw_name, '') AS raw_name, raw_type FROM {dirty}
       UNION ALL SELECT 'tsv', rec_id, nullif(raw_name, ''), raw_type FROM {dirty}
       UNION ALL SELECT 'json', rec_id, raw_name, raw_type FROM {dirty}
       UNION ALL SELECT 'pairs', rec_id, raw_name, raw_type FROM {dirty}""",
)
def sink_roundtrip(spark, sf):
    path = workspace(spark, "sinks")
    rows = view(spark, sf, "dirty").select("rec_id", "raw_name", "raw_type")
    schema = "rec_id long, raw_name string, raw_type string"
    w.write_csv(rows, f"{path}/csv")
    w.write_csv(rows, f"{path}/tsv", sep="\t")
    w.write_json_lines(rows, f"{path}/json")
    texts = rows.select(F.col("rec_id").cast("string").alias("id"), F.to_json(F.struct("raw_name", "raw_type")).alias("text"))
    w.write_pair_lines(texts, "id", "text", f"{path}/lines")

    def delimited(name, sep):
        reader = spark.read.schema(schema).option("header", "true").option("sep", sep).option("escape", '"')
        back = reader.option("multiLine", "true").option("emptyValue", "").csv(f"{path}/{name}")
        return back.withColumn("raw_name", F.nullif("raw_name", F.lit(""))).withColumn("format", F.lit(name))

    lines = spark.read.text(f"{path}/lines").select(F.from_json("value", "array<string>").alias("v"))
    pairs = lines.select(
        F.get("v", F.lit(0)).cast("long").alias("rec_id"),
        F.from_json(F.get("v", F.lit(1)), "raw_name string, raw_type string").alias("t"),
    ).select("rec_id", "t.*", F.lit("pairs").alias("format"))
    out = delimited("csv", ",").unionByName(delimited("tsv", "\t"))
    out = out.unionByName(spark.read.schema(schema).json(f"{path}/json").withColumn("format", F.lit("json")))
    return out.unionByName(pairs)


_PREVIEWS = {
    "customer": ("c_custkey", "c_name", "c_mktsegment"),
    "part": ("p_partkey", "p_name", "p_brand"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey"),
}


def _preview_sql():
    parts = []
    for name, cols in _PREVIEWS.items():
        fields = ", ".join(f"'{c}': {c}" for c in cols)
        parts.append(
            f"SELECT * FROM (SELECT '{name}' AS `table`, row_number() OVER (ORDER BY {cols[0]}) AS position, "
            f"CAST(to_json({{{{{fields}}}}}) AS VARCHAR) AS `row` FROM {name}) WHERE position <= 10"
        )
    return " UNION ALL ".join(parts).replace("{{{{", "{").replace("}}}}", "}").replace("{{", "{").replace("}}", "}")


@query("preview_per_source", _preview_sql())
def preview_per_source(spark, sf):
    tables = {n: table(spark, sf, n).select(*cols) for n, cols in _PREVIEWS.items()}
    out = r.preview(tables, {n: [cols[0]] for n, cols in _PREVIEWS.items()})
    return out.withColumn("position", F.col("position").cast("long"))


_CATALOGUED = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "dirty": ["rec_id", "raw_name", "raw_type", "raw_brand", "size"],
    "labels": ["doc_id", "quality", "toxic"],
    "pages": ["page_id", "url", "html"],
}


@query(
    "attr_catalog",
    " UNION ALL ".join(
        f"SELECT '{t}' AS `table`, '{c}' AS `column`, CAST({k} AS INT) AS ordinal, count(*) AS n_rows, count({c}) AS n_values FROM {{{t}}}"
        for t, columns in _CATALOGUED.items()
        for k, c in enumerate(columns)
    ),
)
def attr_catalog(spark, sf):
    return r.catalog({t: view(spark, sf, t).select(*columns) for t, columns in _CATALOGUED.items()})


@query("head_n", "SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} ORDER BY o_orderkey LIMIT 999")
def head_n(spark, sf):
    return r.first_lines(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 1000, "o_orderkey")


@query(
    "join_pair_lookup_left",
    """SELECT q.ltable_id AS id, coalesce(a.p_name || ' - ' || a.p_brand || ' - ' || a.p_type, '') AS sentence1,
       coalesce(b.c_name || ' - ' || b.c_mktsegment, '') AS sentence2, q.label
       FROM {pairs} q LEFT JOIN {part} a ON a.p_partkey = q.ltable_id LEFT JOIN {customer} b ON b.c_custkey = q.rtable_id""",
)
def join_pair_lookup_left(spark, sf):
    from kindred.operators.text import dash_joined

    a = table(spark, sf, "part").withColumnRenamed("p_partkey", "id")
    b = table(spark, sf, "customer").withColumnRenamed("c_custkey", "id")
    return lookup_pairs(
        view(spark, sf, "pairs"), a, b, dash_joined("p_name", "p_brand", "p_type"), dash_joined("c_name", "c_mktsegment")
    )
