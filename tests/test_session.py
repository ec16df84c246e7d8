import os
from types import SimpleNamespace

import pytest

from kindred.session import cut_lineage, scratch_tables, shared_folder, workspace


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(master, setting=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting), sparkContext=Context(master))


def test_shared_folder():
    assert shared_folder(session("yarn", "hdfs:///shared")) == "hdfs:///shared"
    with pytest.raises(ValueError):
        shared_folder(session("yarn"))
    local = session("local[2]")
    assert shared_folder(local) == shared_folder(local)


def test_cut_lineage(spark):
    assert workspace(spark, "a") != workspace(spark, "a")
    back = cut_lineage(spark.range(5).selectExpr("id", "array(id) as a"))
    assert back.count() == 5 and "Range" not in back._jdf.queryExecution().optimizedPlan().toString()


def test_scratch_tables_go(spark, tmp_path):
    with pytest.raises(ZeroDivisionError):
        with scratch_tables(spark):
            inner = cut_lineage(spark.range(3))
            kept = inner.inputFiles()
            inner.write.parquet(str(tmp_path / "kept"))
            raise ZeroDivisionError
    after = cut_lineage(spark.range(2))
    assert after.count() == 2 and spark.read.parquet(str(tmp_path / "kept")).count() == 3
    assert kept and not any(os.path.exists(f.removeprefix("file://")) for f in kept)
