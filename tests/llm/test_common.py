import pytest
from pyspark.sql import functions as F

from kinetrace.llm import common
from kinetrace.sources.storage import shared_folder


class Session:
    """A session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda *_: None)

    class sparkContext:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: Session.conf)
        getCheckpointDir = staticmethod(lambda: None)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"])
def test_clusters_need_a_shared_folder(monkeypatch, master):
    monkeypatch.setattr(Session.sparkContext, "master", master)
    for find in (common.shared_dir, shared_folder):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            find(Session)


def test_only_small_tables_are_broadcast(spark, monkeypatch):
    work = common.Workspace(spark, "sizes")
    table = work.write(spark.range(1000).select("id", F.rand(1).alias("x")), "t")
    hinted = lambda df: "ResolvedHint (strategy=broadcast)" in df._jdf.queryExecution().analyzed().toString()
    assert 4_000 < common.size_in_bytes(table) < 40_000 and hinted(common.maybe_broadcast(table))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1000)
    assert not hinted(common.maybe_broadcast(table))


def test_dropped_tables_are_gone(spark):
    work = common.Workspace(spark, "drops")
    work.write(spark.range(3), "t")
    work.drop("t")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(f"{work.path}/t")
