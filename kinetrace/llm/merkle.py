"""Merkle manifests of tables: trees of digests over groups of rows, built and checked by Pregel-style supersteps on RDDs.

A superstep is one shuffle of messages.  Upward, nodes send their digest to their parent; a parent that has heard from all
its children hashes and is a node of the next level.  Downward, a node that knows its siblings' path to the root sends each
child that path behind the child's own siblings, until leaves can be checked against the root alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Mapping

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Workspace, maybe_broadcast, partitions

FANOUT = 8
#: Nodes for each task of a superstep; large levels take the session's shuffle partitions.
NODES = 10_000
SIZE = 32
_NODE = "gid long, index long, width long, digest binary, children binary"


def row_digest(values: Iterable[Column]) -> Column:
    """SHA-256, in hex, of values written one after another: `-` for null, else UTF-8 byte count, `:`, value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def placed(rows: DataFrame, group: Column, order: list[Column], work: Workspace, name: str) -> DataFrame:
    """Adds gid (ascending in the order of groups, null first), index (a row's place in its group) and width (the group's rows).

    Rows are dealt out by ranges of group and order, and sorted in their tasks; a place is the place in the task plus the rows
    of the group in tasks before, of which there is one count for each task and group.  No task orders a group as a whole.
    """
    keys = ["group_", *[f"order{i}_" for i in range(len(order))], "salt_"]
    rows = rows.select("*", group.alias("group_"), *[c.alias(f"order{i}_") for i, c in enumerate(order)], F.monotonically_increasing_id().alias("salt_"))
    ranges = [F.col(k).asc_nulls_first() for k in keys]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *ranges).sortWithinPartitions(*ranges)
    dealt = work.write(dealt.withColumn("at_", F.monotonically_increasing_id()).drop(*keys[1:]), f"{name}-sorted")
    # A row's number is its task's number, times 2^33, and its place there.
    part = F.shiftright("at_", 33)
    spans = dealt.groupBy("group_", part.alias("part_")).agg(F.min("at_").alias("first_"), F.count("*").alias("n_"))
    own, before = W.partitionBy("group_"), W.partitionBy("group_").orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select(
        F.col("group_").alias("g_"), F.col("part_").alias("p_"), "first_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"),
        F.sum("n_").over(own).alias("width"), F.min("first_").over(own).alias("gid"),
    )
    spans = work.write(spans, f"{name}-spans")
    met = dealt.withColumn("part_", part).join(maybe_broadcast(spans), F.col("part_").eqNullSafe(F.col("p_")) & F.col("group_").eqNullSafe(F.col("g_")))
    return met.withColumn("index", F.col("before_") + F.col("at_") - F.col("first_")).drop("at_", "part_", "p_", "g_", "first_", "before_").withColumnRenamed("group_", "group")


def combined(digests: bytes) -> bytes:
    """The digest of nodes whose digests stand one after another: that of their hex text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def without(digests: bytes, j: int) -> bytes:
    return digests[: SIZE * j] + digests[SIZE * (j + 1) :]


def folded(digest: bytes, index: int, width: int, path: bytes, fanout: int = FANOUT) -> tuple[bytes, bytes]:
    """The root over a node at ``index`` of ``width`` whose siblings start the path, and what is left of the path."""
    while width > 1:
        j, run = index % fanout, min(fanout, width - index // fanout * fanout)
        near, path = path[: SIZE * (run - 1)], path[SIZE * (run - 1) :]
        digest = combined(near[: SIZE * j] + digest + near[SIZE * j :])
        index, width = index // fanout, -(-width // fanout)
    return digest, path


class Forest:
    """The trees over groups of nodes (gid, index, width, digest, more columns): one written table for each level."""

    def __init__(self, leaves: DataFrame, work: Workspace, name: str, fanout: int = FANOUT):
        self.spark, self.leaves, self.fanout = leaves.sparkSession, leaves, fanout
        count, width = leaves.agg(F.count("*"), F.max("width")).first()
        self.tasks = [min(partitions(self.spark), 1 + count // NODES)]
        self.levels = [leaves.select("gid", "index", "width", "digest", F.lit(b"").alias("children"))]
        while (width or 0) > 1:
            width, count = -(-width // fanout), -(-count // fanout)
            self.tasks.append(min(partitions(self.spark), 1 + count // NODES))
            parents = self.spark.createDataFrame(self._up(self.levels[-1], self.tasks[-1]), _NODE, verifySchema=False)
            self.levels.append(work.write(parents, f"{name}-{len(self.levels)}"))

    def _up(self, level: DataFrame, tasks: int) -> RDD:
        fanout = self.fanout

        def message(node) -> tuple:
            gid, index, width, digest = node
            return (gid, index // fanout), (index % fanout, bytes(digest), width)

        def complete(heard) -> tuple:
            (gid, index), messages = heard
            messages = sorted(messages)
            width = messages[0][2]
            if [m[0] for m in messages] != list(range(min(fanout, width - index * fanout))):
                raise ValueError(f"node {index} of group {gid} has other children than its group's size says")
            children = b"".join(m[1] for m in messages)
            return gid, index, -(-width // fanout), combined(children), children

        return level.where("width > 1").select("gid", "index", "width", "digest").rdd.map(message).groupByKey(tasks).map(complete)

    def tops(self) -> DataFrame:
        """gid, height and digest of each group's root."""
        out = None
        for height, level in enumerate(self.levels):
            own = level.where("width = 1").select("gid", F.lit(height).alias("height"), "digest")
            out = own if out is None else out.unionByName(own)
        return out

    def paths(self, seeds: DataFrame) -> RDD:
        """(leaf row, path, rest of its seed) for every leaf.

        ``seeds`` has a row for each group: gid, height, path (what follows above its root), and more.  A path is the digests
        of siblings, level by level upward and left to right.  Paths go as far as the parents of leaves; those read their
        children beside them, so that a path moves once for all its leaves.
        """
        fanout = self.fanout
        names = [c for c in seeds.columns if c not in ("gid", "height", "path")]

        def seeded(row) -> tuple:
            return (row["gid"], 0), (bytes(row["path"]), tuple(row[c] for c in names))

        def met(heard) -> Iterator[tuple]:
            key, (nodes, inbox) = heard
            for (children,), (path, more) in zip(nodes, inbox, strict=True):
                yield key, (bytes(children), path, more)

        def send(node) -> Iterator[tuple]:
            (gid, index), (children, path, more) = node
            for j in range(len(children) // SIZE):
                yield (gid, index * fanout + j), (without(children, j) + path, more)

        known = seeds.where("height = 0").rdd.map(seeded).mapValues(lambda v: (b"", *v))
        above = None
        for height in range(len(self.levels) - 1, 0, -1):
            inbox = seeds.where(F.col("height") == height).rdd.map(seeded)
            inbox = inbox if above is None else inbox.union(above)
            nodes = self.levels[height].select("gid", "index", "children").rdd.map(lambda r: ((r[0], r[1]), (r[2],)))
            own = nodes.cogroup(inbox, self.tasks[height]).flatMap(met)
            if height > 1:
                above = own.flatMap(send)
            else:
                known = known.union(own)

        def told(heard) -> Iterator[tuple]:
            _, (leaves, parents) = heard
            # One parent, which fanout leaves at most have.
            ((children, path, more),) = parents
            for leaf in leaves:
                yield leaf, without(children, leaf["index"] % fanout) + path, more

        return self.leaves.rdd.map(lambda r: ((r["gid"], r["index"] // fanout), r)).cogroup(known, self.tasks[0]).flatMap(told)


class Manifest:
    """A table's digests: ``leaves`` (key, group, gid, index, width, digest, claimed), ``groups`` (gid, height, digest, index, width) and ``root``, None if empty."""

    def __init__(self, leaves: DataFrame, work: Workspace, fanout: int = FANOUT):
        self.work, self.leaves, self.fanout = work, leaves, fanout
        self.forest = Forest(leaves, work, "level", fanout)
        tops = work.write(self.forest.tops().withColumnRenamed("gid", "own"), "tops")
        self.groups = work.write(placed(tops, F.lit(0), [F.col("own")], work, "groups"), "groups")
        self.top = Forest(self.groups, work, "top", fanout)
        root = self.top.tops().first()
        self.root = bytes(root["digest"]).hex() if root else None

    def verified(self) -> DataFrame:
        """key, leaf, subroot, root, proof_sha256, folded_root, verified: each row's proof, and whether what it claims folds to the root."""
        spark, root, fanout = self.leaves.sparkSession, self.root, self.fanout
        above = self.top.tops().select("gid", "height", F.lit(b"").alias("path"))
        told = self.top.paths(above).map(lambda x: (x[0]["own"], x[0]["height"], x[1], x[0]["index"], x[0]["width"], x[0]["digest"]))
        seeds = spark.createDataFrame(told, "gid long, height int, path binary, place long, groups long, subroot binary", verifySchema=False)
        seeds = self.work.write(seeds, "seeds")

        def checked(known) -> tuple:
            leaf, path, (place, groups, subroot) = known
            claimed = bytes(leaf["claimed"] or leaf["digest"])
            got, rest = folded(claimed, leaf["index"], leaf["width"], path, fanout)
            got, rest = folded(got, place, groups, rest, fanout)
            if rest:
                raise ValueError(f"a path of {len(path) // SIZE} siblings is too long")
            return leaf["key"], bytes(leaf["digest"]).hex(), bytes(subroot).hex(), root, hashlib.sha256(path.hex().encode()).hexdigest(), got.hex(), got.hex() == root

        schema = f"key {self.leaves.schema['key'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return spark.createDataFrame(self.forest.paths(seeds).map(checked), schema, verifySchema=False)


def build_manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), *, key: str = "doc_id", group: str = "lang", claims: Mapping[str, Column] | None = None, fanout: int = FANOUT, work: Workspace | None = None) -> Manifest:
    """The manifest of a table: a leaf for each row, a tree for each group, and a tree over the groups' roots.

    Leaves are digests of ``columns`` and ascend by ``key`` within their ``group``; every ``fanout`` consecutive ones have a
    parent.  ``claims`` are columns as they came back from elsewhere: rows for which one is not null claim the digest of the
    row with these values, and ``verified()`` tells whether it folds to the root along the row's own siblings.

    Texts are read once, into a table of digests.  Null keys and groups come first; rows equal in key are ordered by digest,
    so repeated rows are leaves side by side; nulls, empty and very long values have the digests that ``row_digest`` says.  An
    empty table has root None.  Other columns are not read.  A key, a group or a row may hold any share of the table.
    """
    work = work or Workspace(docs.sparkSession, "merkle")
    claims = claims or {}
    own = {c: F.col(f"`{c}`") for c in columns}
    given = row_digest({**own, **{c: F.coalesce(v, own[c]) for c, v in claims.items()}}.values())
    claimed = F.when(F.coalesce(*claims.values()).isNotNull(), F.unhex(given)) if len(claims) > 1 else F.when(next(iter(claims.values())).isNotNull(), F.unhex(given)) if claims else F.lit(None).cast("binary")
    digests = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").alias("of"), F.unhex(row_digest(own.values())).alias("digest"), claimed.alias("claimed"))
    digests = work.write(digests, "digests")
    leaves = placed(digests, F.col("of"), [F.col("key"), F.col("digest")], work, "leaves").drop("of")
    return Manifest(work.write(leaves, "leaves"), work, fanout)
