"""Registration of the queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from kindred.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


# Texts differ in length by orders of magnitude, so batches for Python workers are bounded by bytes.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
OWN_BATCH_BYTES, DEFAULT_BATCH_BYTES = "8m", "67108864b"


def prepared(spark: SparkSession) -> SparkSession:
    """``spark`` with this package on its workers and, unless the cluster chose another, small Arrow batches."""
    if spark.conf.get(BATCH_BYTES, DEFAULT_BATCH_BYTES) == DEFAULT_BATCH_BYTES:
        spark.conf.set(BATCH_BYTES, OWN_BATCH_BYTES)
    return ship_package(spark)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its twin over the given tables."""

    def register(build: Query) -> Query:
        @wraps(build)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return build(prepared(spark), sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
