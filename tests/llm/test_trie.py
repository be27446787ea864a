"""The prefix trie against a plain trie of rebuilt conversations."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kinetrace.llm.queries import op12_prefix_trie
from kinetrace.llm.trie import _ends, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", sha(role or "", text or ""), text or ""))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in convs.items()}
    nodes = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], {"members": [], "ends": [], "kids": set()})["members"].append(c)
            if d:
                nodes[seq[: d - 1]]["kids"].add(seq[:d])
        nodes[seq]["ends"].append(c)
    for seq in sorted(nodes, key=len, reverse=True):
        n = nodes[seq]
        n["leaves"] = sum(nodes[k]["leaves"] for k in n["kids"]) or 1
        n["saved"] = (len(n["members"]) - 1) * (len(seq[-1][1].encode()) if seq else 0) + sum(nodes[k]["saved"] for k in n["kids"])
    return sorted(
        str((min(n["members"]), len(seq), min(nodes[seq[:-1]]["members"]) if seq else None, len(n["members"]), len(n["kids"]), n["leaves"], n["saved"], hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest()))
        for seq, n in nodes.items()
    )


def odd_rows():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "é à", f"own {c}"])) for c in range(60) for t in range(rng.randrange(9)) if c not in (10, 25)]
    rows += [(c, t, "user", f"copy {t}") for c in range(200, 240) for t in range(4)]
    rows += [(7, None, "user", "first")] * 2 + [(7, 0, "user", "first"), (None, 0, "user", "none"), (-3, 0, "user", "hi"), (-5, 1, "user", "hi"), (301, 5, "u", "Very long " * 100_000), (10**15 + 1, 0, "user", "hi")]
    return rows + [(400 + c, t, "user", f"deep {t}") for c in range(3) for t in range(300)]


def test_query_equals_brute_force(spark, tmp_path):
    turns = spark.createDataFrame(odd_rows(), SCHEMA).withColumns({"node": F.lit(1), "family": F.lit("x"), "own": F.lit(2)})
    turns.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op12_prefix_trie(spark, str(tmp_path))
    assert got.columns == COLUMNS
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(odd_rows())


def test_families_handed_on_in_pieces_and_salted_parents(spark, monkeypatch):
    monkeypatch.setattr("kinetrace.llm.trie.MANY", 3)
    turns = spark.createDataFrame(odd_rows(), SCHEMA)
    assert sorted(str(tuple(r)) for r in prefix_trie(turns, held=4).select(*COLUMNS).collect()) == brute(odd_rows())


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")], [(2, 0, "user", "only")]])
def test_small_tables(spark, rows):
    assert sorted(str(tuple(r)) for r in prefix_trie(spark.createDataFrame(rows, SCHEMA)).select(*COLUMNS).collect()) == brute(rows)


def test_ends_are_a_stream():
    import pyarrow as pa

    ids = list(range(-5, 5000))
    batches = [pa.RecordBatch.from_pydict({"node": pa.array([b"a"] * len(ids[i : i + 100]), pa.binary()), "conv": pa.array(ids[i : i + 100], pa.int64())}) for i in range(0, len(ids), 100)]
    (out,) = _ends(iter(batches))
    assert out.to_pydict() == {"node": [b"a"], "ends_sha256": [hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]}
