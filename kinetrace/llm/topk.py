"""Exact top-k inner products over a bit-sliced index.

Vectors become integers floor(256 * x).  The index keeps blocks of rows as bitmaps: for each dimension and bit, which
rows have that bit set in the component less the block's least one.  A query's products are summed by bitmap arithmetic
- weights' bits from the most significant down, doubling the sum between, full adders within - into slices of a score.
The best rows are selected from the most significant slice downward; rows that tie at the boundary are resolved exactly,
by smaller id, and the selected rows' products are read off the score's slices.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Workspace, maybe_broadcast, partitions

SCALE = 256
BLOCK = 1 << 16
#: Tasks that share the queries of a group of blocks at most; so many times the index travels.
SHARES = 4
ONES = np.uint64(2**64 - 1)
#: Greatest sum of products that 64-bit scores are sure to hold.
LIMIT = 2.0**62


def scaled(flat: np.ndarray) -> np.ndarray:
    """floor(256 * x) of doubles as 64-bit integers."""
    out = np.floor(flat.astype(np.float64) * SCALE)
    if len(out) and np.abs(out).max() >= LIMIT:
        raise ValueError("a component is too large for 64-bit scores")
    return out.astype(np.int64)


class Block:
    """Bit slices of up to BLOCK integer vectors, rows in ascending order of id."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, bits: int, slices: np.ndarray):
        self.ids, self.low, self.bits, self.slices = ids, low, bits, slices
        self.words = slices.shape[2]
        self.valid = np.packbits(np.arange(self.words * 64) < len(ids), bitorder="little").view(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray, rows: np.ndarray) -> Block:
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        n, dims = rows.shape
        low = rows.min(0)
        above = (rows - low).astype(np.uint64)
        bits = max(1, int(above.max()).bit_length())
        words = -(-n // 64)
        padded = np.zeros((dims, words * 64), np.uint64)
        padded[:, :n] = above.T
        slices = np.stack([np.packbits((padded >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for b in range(bits)], 1)
        return cls(ids, low, bits, slices)

    def row(self) -> tuple:
        """As the index stores it: ids, least components, bits, slices."""
        return self.ids.astype("<i8").tobytes(), self.low.astype("<i8").tobytes(), self.bits, self.slices.astype("<u8").tobytes()

    @classmethod
    def read(cls, ids: bytes, low: bytes, bits: int, slices: bytes) -> Block:
        own, least = np.frombuffer(ids, "<i8"), np.frombuffer(low, "<i8")
        return cls(own, least, bits, np.frombuffer(slices, "<u8").reshape(len(least), bits, -(-len(own) // 64)))

    def scores(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of sum |q_d| * u_d, where u_d is the component above its least for
        positive q_d and its complement for negative: the product up to a constant of the query."""
        acc: list[np.ndarray] = []
        weight = np.abs(query)
        flipped: dict[tuple[int, int], np.ndarray] = {}
        for j in range(int(weight.max()).bit_length() - 1, -1, -1):
            if acc:
                acc.insert(0, np.zeros(self.words, np.uint64))
            for d in np.flatnonzero(weight >> j & 1):
                carry = None
                for b in range(self.bits):
                    x = self.slices[d, b]
                    if query[d] < 0:
                        if (d, b) not in flipped:
                            flipped[d, b] = x ^ ONES
                        x = flipped[d, b]
                    if b == len(acc):
                        acc.append(np.zeros(self.words, np.uint64))
                    a = acc[b]
                    t = a ^ x
                    if carry is None:
                        acc[b], carry = t, a & x
                    else:
                        acc[b] = t ^ carry
                        carry = (a & x) | (t & carry)
                b = self.bits
                while b < len(acc):
                    t = acc[b]
                    acc[b] = t ^ carry
                    carry = t & carry
                    b += 1
                if carry.any():
                    acc.append(carry)
        return acc

    def constant(self, query: np.ndarray) -> int:
        """What a product has besides its slices' sum; raises if products may pass 64 bits."""
        top = (1 << self.bits) - 1
        if sum(abs(int(q)) * (abs(int(low)) + top) for q, low in zip(query, self.low, strict=True)) >= LIMIT:
            raise ValueError("products of these vectors may pass 64 bits")
        return sum(int(q) * int(low) + min(0, int(q)) * top for q, low in zip(query, self.low, strict=True))

    def top(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows but those of id ``own``; ties to smaller ids."""
        constant = self.constant(query)
        edge = self.valid.copy()
        for i in range(*np.searchsorted(self.ids, [own, own + 1])):
            edge[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        sure, n_sure = np.zeros(self.words, np.uint64), 0
        slices = self.scores(query)
        for s in reversed(slices):
            t = edge & s
            n = int(np.bitwise_count(t).sum())
            if n_sure + n > k:
                edge = t
            else:
                sure |= t
                n_sure += n
                edge &= ~s
                if n_sure == k:
                    break
        rows = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
        picked = rows(sure)
        if n_sure < k:
            picked = np.concatenate((picked, rows(edge)[: k - n_sure]))
        at, shift = picked >> 6, (picked & 63).astype(np.uint64)
        total = np.zeros(len(picked), np.int64)
        for b, s in enumerate(slices):
            total += ((s[at] >> shift) & np.uint64(1)).astype(np.int64) << b
        return [(int(x) + constant, int(i)) for x, i in zip(total, self.ids[picked], strict=True)]


_INDEX = "block long, ids binary, low binary, bits int, slices binary"


def _blocks(batches):
    """Rows (vec_id, v) to stored blocks of BLOCK rows."""
    from pyspark import TaskContext

    ids, rows, made = [], [], TaskContext.get().partitionId() << 32

    def block(i, r):
        nonlocal made
        made += 1
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((made, *Block.of(i, r).row()), (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()), strict=True)], names=["block", "ids", "low", "bits", "slices"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ids.append(batch.column(0).to_numpy())
        rows.append(scaled(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1))
        while sum(map(len, ids)) >= BLOCK:
            i, r = np.concatenate(ids), np.concatenate(rows)
            yield block(i[:BLOCK], r[:BLOCK])
            ids, rows = [i[BLOCK:]], [r[BLOCK:]]
    if sum(map(len, ids)):
        yield block(np.concatenate(ids), np.concatenate(rows))


def _search(k: int):
    """Rows sorted by (unit, blocks first): queries of a unit against its blocks, k rows each."""

    def run(batches):
        unit, blocks = None, []
        for batch in batches:
            out = []
            units, kinds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (u, kind) in enumerate(zip(units, kinds, strict=True)):
                if u != unit:
                    unit, blocks = u, []
                if kind == 0:
                    blocks.append(Block.read(*(batch.column(c)[i].as_py() for c in range(2, 6))))
                    continue
                query, own = scaled(np.array(batch.column(7)[i].as_py(), np.float64)), batch.column(6)[i].as_py()
                best = heapq.nsmallest(k, (x for b in blocks for x in b.top(query, own, k)), key=lambda x: (-x[0], x[1]))
                out += [(own, i, s) for s, i in best]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def write_index(vectors: DataFrame, work: Workspace, dims: int, n: int) -> DataFrame:
    """Writes the sliced index of ``n`` rows (vec_id, v) of equal length: a row for each block, dealt to groups, of which
    there are as many as tasks that hold one while queries pass by."""
    rows = vectors.repartition(-(-n // BLOCK))
    index = work.write(rows.mapInArrow(_blocks, _INDEX), f"index-{dims}")
    # A row for each block of BLOCK vectors passes through one task.
    groups = min(-(-n // BLOCK), 2 * partitions(vectors.sparkSession))
    place = index.select("block").withColumn("group", (F.row_number().over(W.orderBy("block")) - 1) % groups)
    return index.join(maybe_broadcast(work.write(place, f"groups-{dims}")), "block")


def top_products(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 50, k: int = 5, work: Workspace | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``every`` divides, the k rows of highest integer product.

    All rows but those of the query's own id are candidates.  The index is stored once, in slices; queries travel to it:
    each group of blocks gets every query, or where groups are few, several tasks hold a group and share the queries.
    Groups give k rows a query, of which the best k are kept.  Components count as doubles; sums that may pass 64 bits
    raise an error.  Vectors that are null or empty or hold null or non-finite components take no part, nor do null ids;
    vectors are compared with those of their own length.  A repeated id is searched once (with the least of its vectors)
    and found as often as it stands there; ties go to smaller ids.  An empty table gives an empty result; other columns
    are not read.
    """
    spark = vectors.sparkSession
    work = work or Workspace(spark, "topk")
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    own = own.where(~bad & (F.size("v") > 0)).withColumn("dims", F.size("v"))
    # One row for each length of vectors.
    sizes = {r.dims: r.n for r in own.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    found = None
    for dims, n in sorted(sizes.items()):
        rows = own.where(F.col("dims") == dims).select("vec_id", "v")
        index = write_index(rows, work, dims, n)
        groups = index.agg(F.max("group")).first()[0] + 1
        shares = min(SHARES, -(-2 * partitions(spark) // groups))
        none = lambda kind: F.lit(None).cast(kind)
        held = index.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        held = held.select((F.col("group") * shares + F.col("share")).alias("unit"), F.lit(0).alias("kind"), "ids", "low", "bits", "slices", none("long").alias("query_id"), none("array<double>").alias("v"))
        queries = work.write(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), f"queries-{dims}")
        asked = queries.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        unit = F.col("group") * shares + F.pmod(F.xxhash64("vec_id"), F.lit(shares))
        asked = asked.select(unit.alias("unit"), F.lit(1).alias("kind"), none("binary").alias("ids"), none("binary").alias("low"), none("int").alias("bits"), none("binary").alias("slices"), F.col("vec_id").alias("query_id"), "v")
        dealt = held.union(asked).repartition(groups * shares, "unit").sortWithinPartitions("unit", "kind")
        got = dealt.mapInArrow(_search(k), "query_id long, vec_id long, score long")
        found = got if found is None else found.union(got)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
