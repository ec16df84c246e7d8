"""Rows without ids, many rows of one id, clashing columns, and the pipeline as a whole."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import language_model, mixing, packing, quality
from kindred.session import cut_lineage, ship_package

DOC = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators use inside
INTERNAL = ["label", "part", "index", "value", "score", "predicted", "h", "rank", "block", "p", "key", "row", "copies", "_k0", "shard", "again", "piece", "size", "word", "component_id", "_nth", "_copies", "text_sha256"]


def documents(spark, rows, extra=()):
    ship_package(spark)
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({c: F.lit(k) for k, c in enumerate(extra)}).repartition(3)


def test_packing_deals_rows_without_an_id(spark):
    rng = random.Random(1)
    rows = [(None, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(40)), "en", "s", 1) for _ in range(3000)]
    packed = packing.pack_tokens(documents(spark, rows, INTERNAL), shard_bytes=20_000)
    shards = [r["count"] for r in packed.groupBy("shard").count().collect()]
    assert len(shards) > 20 and max(shards) < packed.count() / 5
    tok = packing.tokenizer(packing.VOCABULARY)
    back = collections.Counter(bytes(r.ids) for r in packing.unpack(packed).collect())
    assert back == collections.Counter(tok([t for _, t, *_ in rows]))


def test_equal_lengths_are_packed_alike_however_rows_come(spark):
    rows = [(k // 4, "same length %d" % (k % 10), "en", "s", 1) for k in range(40)]
    ids = lambda df: sorted((r.shard, r.row, bytes(r.ids)) for r in packing.pack_tokens(df, row_tokens=16).collect())
    assert ids(documents(spark, rows).coalesce(1).sortWithinPartitions("doc_id")) == ids(documents(spark, rows[::-1]).coalesce(1).sortWithinPartitions("doc_id"))


def test_mixing_deals_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 64)
    rows = [(7 if k % 3 else None, "w " * (1 + k % 5), "en", "ab"[k % 2], 1) for k in range(3000)] + [(100 + k, "w w", "en", "a", 1) for k in range(500)]
    docs = documents(spark, rows, [c for c in INTERNAL if c not in ("size", "source")])
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row"))
    dealt = mixing._dealt(cut_lineage(sized.withColumn("h", F.xxhash64("doc_id", F.lit(7)))))
    most = dealt.groupBy(F.pmod("h", F.lit(50)).alias("b")).count().agg(F.max("count")).first()[0]
    assert dealt.count() == 3500 and most < 300
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 3500
    for source in {r.target for r in got}:
        own = [r for r in got if r.target == source]
        assert abs(sum(r.taken for r in own) - source) <= max(3 * r.size for r in own)


def test_quality_with_clashing_columns_and_repeated_labels(spark):
    rows = [(k, ("good prose, all of it. " if k % 2 else "@@ ## 99 !!") * (1 + k % 4), "en", "s", 5) for k in range(60)]
    docs = documents(spark, rows, INTERNAL)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60) for _ in range(40)], "doc_id long, quality int, toxic int")
    machine = quality.fit(docs, labels, F.col("doc_id") % 3 != 1)
    scored = quality.score(docs, machine, docs.columns, "_s").collect()
    assert len(scored) == 60 and sum((r._s >= 0.5) == bool(r.doc_id % 2) for r in scored) > 50
    assert quality._labelled(docs, labels, F.lit(True), 20_000).count() == 60
    # many rows of one labelled id do not exceed the bound either
    same = documents(spark, [(1, f"text {k}", "en", "s", 5) for k in range(4000)], INTERNAL)
    assert 100 < quality._labelled(same, labels, F.lit(True), 400).count() < 520


@pytest.mark.parametrize("most", [0, 1, 5, 37, 200, 399, 400, 1000])
def test_most_frequent_words(spark, most):
    rng = random.Random(4)
    rows = [(rng.getrandbits(64) - 2**63, rng.choice([1, 1, 1, 2, 2, 3, 7, 7, 7, 7, 900, 901])) for _ in range(400)]
    got = language_model._most_frequent(spark.createDataFrame(rows, "word long, c long"), most)
    assert list(zip(got["word"], got["c"], strict=True)) == sorted(rows, key=lambda r: (-r[1], r[0]))[:most]


# the pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with nulls, empty and long texts, repeated rows, copies, benchmark items and clashing columns."""
    ship_package(spark)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    junk = lambda n: " ".join(rng.choice(["@@", "##", "||", "9 9", "=="]) for _ in range(n))
    item = prose(40)
    rows = [(k, prose(rng.randint(30, 90)), "en", "abc"[k % 3], 200) for k in range(80)]
    rows += [(100 + k, junk(60), "en", "a", 200) for k in range(60)]
    copied = rows[3][1]
    rows += [(200 + k, copied, "en", "b", 200) for k in range(5)] + [(210, copied + " more", "en", "b", 200)]
    rows += [(220, prose(20) + " " + item + " " + prose(20), "en", "c", 200)]
    rows += [(230, prose(9000), "en", "c", None), (231, None, None, None, None), (232, "", "en", "a", 0), (None, prose(30), "en", "a", 1), (None, prose(30), "en", "a", 1)]
    rows += [rows[10], rows[10]]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = documents(spark, rows, [c for c in INTERNAL if not c.startswith("_")])
    docs.write.parquet(f"{path}/documents.parquet")
    marks = [(k, 1, 0) for k in range(80)] + [(100 + k, 0, 0) for k in range(60)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, item


def test_pipeline_stage_by_stage(spark, folder):
    path, rows, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, path))
        assert docs.columns == columns, name
        seen[name] = docs.select("doc_id", "text").collect()
    kept = {r.doc_id for r in seen["quality"]}
    assert len(kept & set(range(80))) >= 75 and len(kept & set(range(100, 160))) <= 5
    groups = {3, *range(200, 206), 210} & kept
    after = {r.doc_id for r in seen["duplicates"]}
    assert len(groups) > 1 and len(groups & after) == 1 and (kept - groups - {None}) <= after
    assert sum(r.doc_id == 10 for r in seen["duplicates"]) == 1
    assert not any(item in (r.text or "") for r in seen["leaks"]) and {r.doc_id for r in seen["leaks"]} == after - {220}
    assert {r.doc_id for r in seen["mixture"]} <= after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    tok = packing.tokenizer(packing.VOCABULARY)
    back = collections.defaultdict(list)
    for r in packing.unpack(packed).collect():
        back[r.doc_id].append((r.piece, bytes(r.ids)))
    want = collections.Counter(r.doc_id for r in seen["mixture"])
    texts = {r.doc_id: r.text for r in seen["mixture"]}
    for k, n in want.items():
        if k is not None:
            (whole,) = tok([texts[k]])
            assert sum(len(p) for _, p in back[k]) == n * len(whole)


def test_pipeline_whole_and_on_nothing(spark, folder, tmp_path):
    path, _, _ = folder
    assert corpus_pipeline.run(spark, path).count() > 0
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("partitions", ["4", "300"])
def test_sliced_sums_in_one_and_two_steps(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = [(k % language_model.SLICES, bytearray(np.array([k, 1], dtype="<f4").tobytes())) for k in range(320)]
        found = language_model._sliced_sum(spark.createDataFrame(rows, "slice int, blob binary").repartition(7), "<f4")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {k: v.tolist() for k, v in found.items()} == {k: [float(sum(range(k, 320, 16))), 20.0] for k in range(16)}
