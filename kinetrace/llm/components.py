"""Connected components of an edge table, never gathered in one place."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Star edges up to which one task finishes the job; they are counted first, and more go through rounds.
ONE_TASK = 100_000


def _local_stars(batches):
    """Replaces a partition's edges by (node, smallest node of its local component): fewer edges, same components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for i in range(0, len(nodes), 1 << 16):
        some = nodes[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], names=["v", "m"])


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: longs), the component being its smallest node.

    Each partition first replaces its edges by local stars.  If few edges are left, one task joins them; else large-star
    and small-star steps alternate until the edges are stars already.  Nodes without edges are not returned.  Each round is written to the shared folder.
    """
    two = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    star = work.write(two.mapInArrow(_local_stars, "v long, m long").distinct(), f"{name}-0")
    if star.count() <= ONE_TASK:
        after = star.coalesce(1).mapInArrow(_local_stars, "v long, m long")
        return _with_roots(work.write(after, f"{name}-1"))
    turn = 0
    while True:
        both = star.union(star.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = both.groupBy("v").agg(F.min("m").alias("low")).select("v", F.least("v", "low").alias("low"))
        large = both.join(low, "v").where("m > v").select(F.col("m").alias("v"), F.col("low").alias("m")).distinct()
        # Small star: every node's lower neighbours, itself included, meet at the lowest.
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("low").alias("m")), F.struct("v", F.col("low").alias("m")))).alias("e")).select("e.*").where("v <> m").distinct()
        turn += 1
        after = work.write(small, f"{name}-{turn}")
        count = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if count(star) == count(after):
            break
        work.drop(f"{name}-{turn - 1}")
        star = after
    return _with_roots(after)


def _with_roots(star: DataFrame) -> DataFrame:
    return star.select(F.col("v").alias("node"), F.col("m").alias("component")).union(star.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
