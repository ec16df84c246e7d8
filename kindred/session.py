"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "kindred", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; the cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the Python workers of this session the package (once per Spark context)."""
    context = spark.sparkContext
    if any(name.startswith("kindred-") for name in context._python_includes):
        return spark
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / f"kindred-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, str(source.relative_to(root.parent)))
    context.addPyFile(str(target))  # the driver's copy; Spark sends it to the executors
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    On a local master without that setting a scratch folder is made and set as the context's
    checkpoint folder; on a cluster a missing setting is an error, since a folder of one machine
    would be lost with it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="kindred-"))
        folder = context.getCheckpointDir()
    return folder


def workspace(spark: SparkSession, label: str) -> str:
    """A new path for one written table inside the shared folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


_open_scratch: list[list[str]] = []


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`cut_lineage` writes inside are deleted at the end; what is wanted longer is written elsewhere."""
    made: list[str] = []
    _open_scratch.append(made)
    try:
        yield
    finally:
        _open_scratch.remove(made)
        for path in made:
            delete_table(spark, path)


def delete_table(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    What follows neither repeats the work before nor loses it with an executor, and is planned
    with the true size of the table.
    """
    path = workspace(df.sparkSession, "table")
    if _open_scratch:
        _open_scratch[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
