"""The registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm import chat, decontaminate, exact_dedup, fill_in_middle, html_extract, jaccard_join, language_model, mixing, packing, prefix_trie, quality, repeats, winnowing
from kindred.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


@query(
    "op5_block_naming_dedup",
    """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf, "documents"))


@query("op7_pivotal_mixing")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def conversation_events(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of ``conversations``, and the control conversation -1, as one delta event each."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.sql(
        f"SELECT -1L AS conv_id, turn, role, '{CONTROL_TEXT}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return (
        rows.unionByName(control)
        .withColumn("seq", F.row_number().over(order).cast("long"))
        .select("conv_id", "seq", F.col("seq").alias("turn"), F.lit("delta").alias("kind"), "role", "text")
    )


@query(
    "op8_event_chat_format",
    r"""
    WITH rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), esc AS (
      SELECT *, length(replace(replace(replace(text, '~', '~0'), '<', '~1'), '[', '~2')) AS e,
             length(replace(replace(replace(replace(role, '~', '~0'), '<', '~1'), '[', '~2'), chr(10), '~3')) AS r
      FROM rows
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
           sum(12 + r + 1 + e + 11)::BIGINT AS formatted_chars
    FROM esc GROUP BY conv_id
    """,
)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    formatted = chat.format_chats(conversation_events(spark, sf))
    turns = chat.read_back(formatted).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("k", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("line")))).alias("lines"),
        F.sort_array(F.collect_list(F.when(F.col("learned_text").isNotNull(), F.struct("k", "learned_text")))).alias("learned"),
    )
    loss = F.array_join(F.transform("learned", lambda x: x["learned_text"]), "")
    read = turns.select(
        F.col("conv_id").alias("_c"),
        "n_turns",
        F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
    )
    lengths = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"))
    return lengths.join(read, F.col("conv_id").eqNullSafe(F.col("_c"))).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


@query(
    "op1_jaccard_metric_join",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS w FROM documents
    ), s AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
    b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
    r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, b.y FROM r JOIN b ON b.x = r.reach)
    SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(reach) AS component_id
    FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1
    """,
)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf, "documents"))


@query("op2_token_packing")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_tokens(table(spark, sf, "documents"))


@query("op3_simhash_decontamination")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op9_text_density_html")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf, "pages"))


def quality_scores(docs: DataFrame, labels: DataFrame, keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` and the score of every document; learned without the third of ids that is held out."""
    machine = quality.fit(docs, labels, ~quality.held_out(3)(F.col("doc_id")))
    return quality.score(docs, machine, keep, name)


@query("op4_maxent_language_model")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    scored = language_model.score_texts(table(spark, sf, "documents"), lambda doc_id: ~quality.held_out(5)(doc_id))
    return scored.select(
        "doc_id", quality.held_out(5)(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op6_factorisation_quality")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    scored = quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])
    return scored.select(
        "doc_id", quality.held_out(3)(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op10_column_bwt_repeats")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf, "documents")).select(
        "doc_id",
        "n_bytes",
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["length"]), F.lit(0)).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query(
    "op12_fill_in_middle",
    r"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
    ), k AS (
      SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                    OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
                  WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
      FROM d
    ), c AS (
      SELECT *, substr(t, 1, least(c1, c2)) AS p, substr(t, least(c1, c2) + 1, abs(c1 - c2)) AS m, substr(t, greatest(c1, c2) + 1) AS s FROM k
    )
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN least(c1, c2) END::BIGINT AS prefix_chars,
           CASE WHEN form <> 'plain' THEN abs(c1 - c2) END::BIGINT AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                  ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM c
    """,
)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    formatted = fill_in_middle.fill_in_middle(table(spark, sf, "documents"))
    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    digested = formatted.select(*kept, "output", F.sha2("output", 256).alias("output_sha256"))
    return fill_in_middle.restore(digested).select(*kept, "output_sha256", F.sha2("restored", 256).alias("restored_sha256"))


@query(
    "op11_winnowing_fingerprints",
    r"""
    WITH x AS (
      SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, coalesce(lead(coalesce(text, '')) OVER o, first_value(coalesce(text, '')) OVER o) AS nt,
             CASE WHEN row_number() OVER o < count(*) OVER () THEN lead(doc_id) OVER o ELSE first_value(doc_id) OVER o END AS nd
      FROM documents WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, sha256(coalesce(text, '')))
    ), e AS (SELECT *, left(t, n - n // 3) || left(nt, n // 3) AS ed FROM x),
    c AS (
      SELECT doc_id, k, list_transform(regexp_extract_all(t, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]|[^\x20\x09-\x0D\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]{1,16}'),
             lambda u: ('0x' || substr(md5(u), 1, 15))::BIGINT % 140737488355213) AS c
      FROM (SELECT doc_id, 0 AS k, t FROM e UNION ALL SELECT doc_id, 1, ed FROM e)
    ), p AS (SELECT doc_id, k, len(c) AS l, unnest(c) AS c, generate_subscripts(c, 1) - 1 AS i FROM c WHERE len(c) >= 5),
    h AS (
      SELECT doc_id, k, i, l - 4 AS g, (c * 28561 + lead(c, 1) OVER w * 2197 + lead(c, 2) OVER w * 169 + lead(c, 3) OVER w * 13 + lead(c, 4) OVER w) % 140737488355213 AS h
      FROM p WINDOW w AS (PARTITION BY doc_id, k ORDER BY i)
      UNION ALL SELECT doc_id, k, 0, 1, list_reduce(c, lambda a, b: (a * 13 + b) % 140737488355213) FROM c WHERE len(c) BETWEEN 1 AND 4
    ), m AS (
      SELECT doc_id, k, i, g, min(h::HUGEINT * 1000000000 + (999999999 - i)) OVER (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS m
      FROM h WHERE i < g
    ), s AS (SELECT DISTINCT doc_id, k, (m // 1000000000)::BIGINT AS h, (999999999 - m % 1000000000)::BIGINT AS i FROM m WHERE i + 16 <= g OR i = 0),
    f AS (SELECT doc_id, k, string_agg(format('{:x}', h) || ':' || i, ' ' ORDER BY i) AS f, list(DISTINCT h) AS hs FROM s GROUP BY 1, 2),
    j AS (
      SELECT e.doc_id, n, ed, coalesce(a.f, '') AS f, coalesce(b.f, '') AS g, coalesce(a.hs, []) AS p, coalesce(b.hs, []) AS q, coalesce(z.hs, []) AS r
      FROM e LEFT JOIN f a ON a.doc_id = e.doc_id AND a.k = 0 LEFT JOIN f b ON b.doc_id = e.doc_id AND b.k = 1 LEFT JOIN f z ON z.doc_id = e.nd AND z.k = 0
    )
    SELECT doc_id, n::BIGINT AS n_chars, sha256(ed) AS edited_sha256, f AS fingerprint, g AS edited_fingerprint,
           CASE WHEN len(p) + len(q) = 0 THEN 1.0 ELSE len(list_intersect(p, q)) / len(list_distinct(list_concat(p, q))) END::DOUBLE AS near_edited,
           CASE WHEN len(p) + len(r) = 0 THEN 1.0 ELSE len(list_intersect(p, r)) / len(list_distinct(list_concat(p, r))) END::DOUBLE AS near_next
    FROM j
    """,
)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return winnowing.edited_fingerprints(table(spark, sf, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        winnowing.as_text(F.col("fingerprint")).alias("fingerprint"),
        winnowing.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query(
    "op13_zfast_conversation_trie",
    r"""
    WITH s AS (
      SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS s,
             length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL
    ), o AS (
      SELECT conv_id, list({'s': s, 'n': n} ORDER BY turn NULLS FIRST, s) AS t FROM s GROUP BY conv_id
    ), c AS (
      SELECT conv_id, t, conv_id - conv_id % 100 AS base, xor(list_reduce(
        list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) % 6 AS h
      FROM o
    ), b AS (
      SELECT c.conv_id, list_concat(CASE WHEN h = 0 THEN [] ELSE coalesce(o.t[1:h], []) END, c.t[h + 1:]) AS t
      FROM c LEFT JOIN o ON o.conv_id = c.base
    ), n AS (
      SELECT conv_id, d, len(t) AS l, coalesce(array_to_string(list_transform(t[1:d], lambda x: x.s), ''), '') AS p,
             CASE WHEN d = 0 THEN 0 ELSE t[d].n END AS chars
      FROM b, unnest(range(0, len(t) + 1)) AS u(d)
    ), g AS (
      SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
             sha256(coalesce(string_agg(CASE WHEN d = l THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
      FROM n GROUP BY p, d
    ), k AS (SELECT left(p, 64 * (d - 1)) AS p, d - 1 AS d, count(*) AS n_children FROM g WHERE d > 0 GROUP BY ALL),
    m AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k ON k.p = g.p AND k.d = g.d),
    a AS (
      SELECT left(p, 64 * e) AS p, e AS d, sum((n_convs - 1) * chars) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
      FROM m, unnest(range(0, d + 1)) AS u(e) GROUP BY ALL
    )
    SELECT m.conv_id, m.d AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
    FROM m JOIN a ON a.p = m.p AND a.d = m.d LEFT JOIN m AS up ON up.d = m.d - 1 AND up.p = left(m.p, 64 * (m.d - 1))
    """,
)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.branched(table(spark, sf, "conversations")))
