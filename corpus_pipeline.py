"""The training-data pipeline over ``documents``: five stages, each written and read again.

quality      documents the classifier rejects go
duplicates   of every group of near duplicates the document with the smallest id stays
leaks        documents that hold a benchmark item go
mixture      every document is repeated as often as the mix takes it, or goes
tokens       rows of packed token ids

All stages but the last return the columns of ``documents``.

Every stage has defined results on empty input. Documents without an id are kept by the duplicate and
leak stages, which decide by id; of repeated rows of one id the duplicate stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm import decontaminate, jaccard_join, mixing, packing
from kindred.llm.queries import quality_scores
from kindred.llm.registry import prepared, table
from kindred.session import cut_lineage, delete_table, scratch_tables, workspace


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more."""
    prepared(spark)
    scored = quality_scores(docs, table(spark, sf_dir, "labels"), docs.columns, "_quality_score")
    return scored.where("_quality_score >= 0.5").select(*docs.columns)


def _numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``_nth``: 1 for an id that occurs once, else the place among the rows of the id."""
    repeated = cut_lineage(
        rows.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_repeated"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("_repeated"))
    single = rows.join(repeated, same, "left_anti").withColumn("_nth", F.lit(1))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    return single.unionByName(rows.join(repeated, same, "left_semi").withColumn("_nth", nth))


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one that names it."""
    prepared(spark)
    found = jaccard_join.jaccard_components(docs.select("doc_id", "text"))
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    stay = docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")
    once = _numbered(stay, F.xxhash64("text")).where("_nth = 1 or doc_id is null")
    return once.select(*docs.columns)


def leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    prepared(spark)
    leaks = decontaminate.find_leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return docs.join(cut_lineage(leaks.select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    prepared(spark)
    mixed = mixing.mix_sources(docs.select("doc_id", "text", "source")).select("doc_id", "size", "copies")
    taken = _numbered(cut_lineage(mixed), F.col("size"), F.col("copies")).select(
        F.col("doc_id").alias("_id"), F.col("_nth").alias("_at"), F.col("copies").alias("_copies")
    )
    rows = _numbered(docs, mixing.word_count(F.col("text")), F.xxhash64("source"))
    met = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_nth") == F.col("_at"))).where("_copies > 0")
    return met.withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)"))).select(*docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of packed token ids."""
    prepared(spark)
    return packing.pack_tokens(docs.select("doc_id", "text"))


STAGES = [
    ("quality", quality_stage),
    ("duplicates", duplicates_stage),
    ("leaks", leaks_stage),
    ("mixture", mixture_stage),
    ("tokens", tokens_stage),
]

# Learned scores, drawn copies and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read before the next.

    What a stage wrote on its way goes when its result is written, and that result when the next one is.
    """
    prepared(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = workspace(spark, name)
        with scratch_tables(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        if before:
            delete_table(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
