"""Merkle manifests against a plain recursion, with odd rows, and what tampering does."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kinetrace.llm.common import Workspace
from kinetrace.llm.merkle import build_manifest, folded, placed
from kinetrace.llm.queries import op11_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(digests):
    """Root, and for each leaf the levels (siblings before, siblings after)."""
    paths, places, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for k, at in enumerate(places):
            lo = at // 8 * 8
            paths[k].append((level[lo:at], level[at + 1 : lo + 8]))
            places[k] = at // 8
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], paths


def brute(rows):
    groups, out = {}, []
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    own = {g: tree([leaf(*r) for r in groups[g]]) for g in langs}
    root, above = tree([own[g][0] for g in langs])
    for n, g in enumerate(langs):
        for r, path in zip(groups[g], own[g][1], strict=True):
            steps = path + above[n]
            at = leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                at = leaf(r[0], r[1].translate(LOWER), *r[2:])
            for before, after in steps:
                at = sha("".join([*before, at, *after]))
            out.append((r[0], leaf(*r), own[g][0], root, sha("".join("".join(b + a) for b, a in steps)), at, at == root))
    return sorted(map(str, out))


def odd_rows():
    rng = random.Random(5)
    rows = [(i * 3, f"Text {i} É", rng.choice(["en", "en", "en", "de", None]), rng.choice(["web", None, ""]), i) for i in range(150)]
    rows += [(1000 + i, "One each", f"l{i}", "s", 1) for i in range(9)]
    rows += [(7, "same", "en", "web", 4)] * 20 + [(7, "other", "en", "web", 5), (None, "No id", "en", None, None), (None, None, None, None, None)]
    return rows + [(8, None, "fr", "s", None), (9, "", "", "", 0), (10, "Very Long " * 200_000, "long", "s", 2_000_000)]


def query(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"index": F.lit(1), "gid": F.lit("x"), "key": F.lit(2), "group_": F.lit(0)})
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return op11_merkle_manifest(spark, str(tmp_path))


def test_query_equals_brute_force(spark, tmp_path):
    got = query(spark, tmp_path, odd_rows())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(odd_rows())


@pytest.mark.parametrize("rows", [[(1, "Alone", "en", "s", 5)], [(1, "a", None, None, None), (2, "b", "en", "s", 1)], [(i, "x", "en", "s", 1) for i in range(65)]])
def test_small_forests(spark, tmp_path, rows):
    assert sorted(str(tuple(r)) for r in query(spark, tmp_path, rows).collect()) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []).collect() == []


def test_other_columns_and_fanout(spark):
    docs = spark.range(100).selectExpr("id as k", "id % 3 as part", "cast(id as string) as body")
    build = lambda d, **m: build_manifest(d, ("k", "body"), key="k", group="part", fanout=2, **m)
    kept = build(docs)
    assert kept.verified().where("not verified").count() == 0 and len(kept.forest.levels) == 7
    assert build(docs.repartition(7)).root == kept.root
    assert build(docs.withColumn("body", F.when(F.col("k") == 50, "X").otherwise(F.col("body")))).root != kept.root
    bad = build(docs, claims={"body": F.when(F.col("k") == 50, F.lit("X"))}).verified().where("not verified").collect()
    assert [r.key for r in bad] == [50]


def test_a_lost_child_is_an_error(spark):
    kept = build_manifest(spark.range(100).selectExpr("id as k", "1 as part"), ("k",), key="k", group="part")
    with pytest.raises(Exception, match="other children"):
        kept.forest._up(kept.leaves.where("index <> 20"), 2).collect()


def test_places_need_no_window_over_a_group(spark):
    work = Workspace(spark, "t")
    rows = work.write(spark.range(3000).selectExpr("if(id < 2000, null, id % 2) as g", "5 - id % 6 as k"), "rows")
    out = placed(rows, F.col("g"), [F.col("k")], work, "p").collect()
    for g, n in ((None, 2000), (0, 500), (1, 500)):
        own = sorted((r["index"], r["k"]) for r in out if r.group == g)
        assert [i for i, _ in own] == list(range(n)) and [k for _, k in own] == sorted(k for _, k in own)
        assert {r.width for r in out if r.group == g} == {n}
    assert folded(b"x" * 32, 0, 1, b"rest") == (b"x" * 32, b"rest")
