"""The prefix trie of conversations, merged family by family first.

Conversations of a family share the turns of its base.  One shuffle on the base's id brings a family together, base first;
its small trie is built from a stream of sorted turns, and only the family's combined nodes are shuffled for the trie of all.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, partitions

#: Conversations of a family, and the bound of the hash that says how many turns one takes from its base.
FAMILY, HEADS = 5, 9
#: Nodes of a family that a task holds before it hands on what it has combined so far.
HELD = 50_000
#: Children from which a parent meets them in several places.
MANY = 1_000
ROOT = hashlib.sha256(b"").digest()
_NODE = "node binary, parent binary, family long, depth long, bytes long, above long, members array<long>, ends array<long>"
_NODE_ARROW = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("family", pa.int64()), ("depth", pa.int64()), ("bytes", pa.int64()), ("above", pa.int64()), ("members", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def heads(conv_id: int) -> int:
    """Turns that a conversation takes from the base of its family."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn: the role's UTF-8 byte count, `:`, role and text."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


class _Family:
    """The trie of one family: node -> [parent, depth, bytes, bytes above, members, members that end here]; and its base's first turns."""

    def __init__(self, family: int):
        self.family, self.nodes, self.base = family, {}, []

    def at(self, node: bytes, parent: bytes, depth: int, size: int, above: int) -> list:
        return self.nodes.setdefault(node, [parent, depth, size, above, [], []])

    def rows(self) -> pa.RecordBatch:
        items = list(self.nodes.items())
        columns = [[k for k, _ in items], [v[0] for _, v in items], [self.family] * len(items), *[[v[i] for _, v in items] for i in range(1, 6)]]
        self.nodes = {}
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _NODE_ARROW.types, strict=True)], schema=_NODE_ARROW)


class _Walk:
    """One conversation's way down its family's trie."""

    def __init__(self, trie: _Family, conv: int):
        self.trie, self.conv, self.take, self.read = trie, conv, heads(conv), 0
        self.here, self.total = (ROOT, b"", 0, 0, 0), 0
        self.trie.at(*self.here)[4].append(conv)
        if conv != trie.family:
            for turn in trie.base[: self.take]:
                self.step(*turn)

    def step(self, digest: bytes, size: int) -> None:
        node, depth = self.here[0], self.here[2]
        self.here = (hashlib.sha256(node + digest).digest(), node, depth + 1, size, self.total)
        self.total += size
        self.trie.at(*self.here)[4].append(self.conv)

    def turn(self, digest: bytes, size: int) -> None:
        """An own turn; the base's are its family's heads and its own alike."""
        if self.conv == self.trie.family:
            if self.read < HEADS - 1:
                self.trie.base.append((digest, size))
            self.step(digest, size)
        elif self.read >= self.take:
            self.step(digest, size)
        self.read += 1

    def end(self) -> None:
        self.trie.at(*self.here)[5].append(self.conv)


def _families(held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Combined nodes of families from turns (family, conv, digest, bytes) that are sorted within the task."""

    def run(batches):
        trie, walk = None, None
        for batch in batches:
            for family, conv, digest, size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if walk is not None and conv != walk.conv:
                    walk.end()
                    walk = None
                if trie is None or family != trie.family:
                    if trie is not None:
                        yield trie.rows()
                    trie = _Family(family)
                walk = walk or _Walk(trie, conv)
                walk.turn(digest, size)
                if len(trie.nodes) >= held:
                    # What is merged later need not be complete here.
                    yield trie.rows()
        if trie is not None:
            walk.end()
            yield trie.rows()

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each node, from rows (node, conv) sorted by both: no list of ids is held."""
    node, sha, out = None, None, []
    for batch in batches:
        for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != node:
                if node is not None:
                    out.append((node, sha.hexdigest()))
                node, sha = own, hashlib.sha256(str(conv).encode())
            else:
                sha.update(b",%d" % conv)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.binary()), pa.array([h for _, h in out])], names=["node", "ends_sha256"])
            out = []
    if node is not None:
        out.append((node, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.binary()), pa.array([h for _, h in out])], names=["node", "ends_sha256"])


def prefix_trie(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", held: int = HELD, work: Workspace | None = None) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: node, parent (digests), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation c is rebuilt from the first h turns of c - c % FAMILY and its own after the first h, h being its id's CRC-32
    modulo HEADS.  A node's name is the SHA-256 of its parent's name and its last turn's digest, so texts are hashed before the
    first shuffle and never move.

    * Families: one shuffle on the base's id brings base and members together, sorted, base first.  A task keeps the base's
      first turns, the conversation's last node and up to ``held`` nodes; more are handed on and combined later.
    * Merging: combined family nodes meet on their name.  A node belongs to its smallest member, so along a conversation the
      nodes it owns are its last ones.  It saves the bytes of those before, and a node's saved bytes are what its members
      save from its depth on: sums over members instead of rounds from leaves to the root, whatever the depth.
    * Ends: one row a conversation, sorted by node and id and hashed as a stream.

    Turns are ordered by turn, null first, then role, then the digest of role and text; repeated rows are turns like others.
    Null roles and texts are empty, rows without conv_id take no part, empty and very long texts are turns like others.  An
    empty table gives no node, not even a root.  Other columns are not read.  A conversation of any length is read as a stream
    by one task, and so are the ids that end at one node; a hot node is combined before it is shuffled.
    """
    work = work or Workspace(turns.sparkSession, "trie")
    parts = partitions(turns.sparkSession)
    conv, said, who = F.col(f"`{conv_id}`").cast("long"), F.coalesce(F.col(f"`{text}`"), F.lit("")), F.coalesce(F.col(f"`{role}`"), F.lit(""))
    rows = turns.where(F.col(f"`{conv_id}`").isNotNull()).select(
        (conv - F.pmod(conv, F.lit(FAMILY))).alias("family"), conv.alias("conv"), F.col(f"`{turn}`").alias("turn"), who.alias("role"), turn_digest(who, said).alias("digest"), F.octet_length(said).cast("long").alias("bytes")
    )
    stream = rows.repartition(parts, "family").sortWithinPartitions("family", "conv", F.col("turn").asc_nulls_first(), "role", "digest")
    combined = work.write(stream.select("family", "conv", "digest", "bytes").mapInArrow(_families(held), _NODE), "families")

    merged = combined.groupBy("node", "parent", "depth", "bytes", "above").agg(F.min(F.array_min("members")).alias("conv_id"), F.sum(F.size("members").cast("long")).alias("n_convs"))
    merged = work.write(merged, "merged")
    kids = merged.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = work.write(merged.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    # What each conversation shares, in bytes, and whether a leaf is its own.
    owners = nodes.groupBy(F.col("conv_id").alias("conv")).agg(F.min("above").alias("shared"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    ended = combined.select("family", "node", (F.col("above") + F.col("bytes")).alias("total"), F.explode("ends").alias("conv"))
    own = ended.join(owners, "conv", "left").select("family", "conv", F.struct(F.coalesce("shared", "total").alias("shared"), F.coalesce("leaves", F.lit(0).cast("long")).alias("leaves")).alias("own"))
    families = work.write(own.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("conv", "own"))).alias("own")), "conversations")

    def of(c: Column) -> Column:
        return F.element_at("own", c)

    saved = F.aggregate("members", F.lit(0).cast("long"), lambda a, c: a + F.greatest(of(c)["shared"] - F.col("above"), F.lit(0).cast("long")))
    leaves = F.aggregate("members", F.lit(0).cast("long"), lambda a, c: a + of(c)["leaves"])
    sums = combined.join(families, "family").select("node", saved.alias("saved"), leaves.alias("leaves")).groupBy("node").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    hashes = ended.select("node", "conv").repartition(parts, "node").sortWithinPartitions("node", "conv").mapInArrow(_ends, "node binary, ends_sha256 string")

    # Parents of many children are few and are met in as many places as there are salts; others have a bounded number of rows.
    salts = 64
    salt = F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")
    hot = nodes.where(F.col("n_children") >= MANY).select(F.col("node").alias("parent"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("conv_id").alias("hot"))
    met = work.write(nodes.withColumn("salt", salt).join(work.write(hot, "hot"), ["parent", "salt"], "left").drop("salt"), "met")
    cold = met.where(F.col("hot").isNull()).join(nodes.where(F.col("n_children") < MANY).select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left")
    named = met.where(F.col("hot").isNotNull()).withColumnRenamed("hot", "parent_conv_id").unionByName(cold.drop("hot"))

    out = named.join(sums, "node").join(hashes, "node", "left")
    return out.select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
