from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ringwatch.session import cut_lineage, shared_folder


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(master, configured=None):
    return SimpleNamespace(sparkContext=Context(master), conf=SimpleNamespace(get=lambda key, default: configured))


def test_configured_folder_wins():
    assert shared_folder(session("yarn", "hdfs:///shared")) == "hdfs:///shared"


def test_cluster_without_a_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("yarn"))


def test_local_master_makes_one_up_once():
    s = session("local[2]")
    assert shared_folder(s) == shared_folder(s)


def test_lineage_is_cut(spark):
    df = cut_lineage(spark.range(10).selectExpr("id % 3 as k").groupBy("k").count())
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 3


def test_a_written_table_carries_no_estimate_past_all_bounds(spark):
    """Spark's estimate of a join is a product: over rounds its digits would double each time."""
    rows = spark.range(50).select("id", F.col("id").alias("v"))
    for _ in range(9):
        rows = cut_lineage(rows.join(rows.select("id", F.col("v").alias("w")), "id").select("id", (F.col("v") + F.col("w")).alias("v")))
    assert rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**63
    assert {r["id"]: r["v"] for r in rows.collect()} == {i: i * 512 for i in range(50)}
