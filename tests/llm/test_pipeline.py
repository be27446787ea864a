"""The pipeline's stages: columns and counts, odd rows, and on a small fixture each against brute force, but for toxicity: there
rows are held against the scores of the same fitted model."""

import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinetrace.llm.common import Workspace
from kinetrace.llm.toxicity import fit_toxicity

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        seen[name] = out.count()
        if name == "tokens":
            break
        assert out.columns == columns, name
        kept = out.select("doc_id").distinct()
        assert kept.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
    assert before >= seen["toxicity"] >= seen["near duplicates"] >= seen["decontamination"] > 0
    assert seen["tokens"] == seen["mixing"]
    starts = out.orderBy("start").select("start", "n_tokens", "doc_id").collect()
    assert all(a.start + a.n_tokens == b.start and a.doc_id <= b.doc_id for a, b in zip(starts[:-1], starts[1:], strict=True))


def test_run_and_nulls(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0
    odd = spark.createDataFrame([(None, "a b c d e f", "en", "s", 1), (1, None, None, None, None), (2, "", "en", None, 0), (3, "x y z " * 9, "en", "s", 1), (3, "x y z " * 9, "en", "s", 1), (4, "X y z " * 9, "en", "t", 1)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    kept = corpus_pipeline.near_duplicates(spark, odd, SF)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "None"]
    mixed = corpus_pipeline.mixing(spark, kept, SF)
    assert mixed.columns == odd.columns and mixed.where(F.col("text").isNull()).count() == 0
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


@pytest.fixture(scope="module")
def fixture(spark):
    """Texts of the small tables, copies and edits of some, benchmark items in others, and odd rows."""
    rng = random.Random(2)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(90).collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(3).collect()]
    more = []
    for i, row in enumerate(docs[:12]):
        own = row[1].split(" ")
        if len(own) > 40:
            own[rng.randrange(len(own))] = "other"
        more.append((1000 + i, " ".join(own), *row[2:]))
    more += [(1100 + i, f"{docs[20 + i][1]} {t}", *docs[20 + i][2:]) for i, t in enumerate(items)]
    more += [(2000, None, None, None, None), (2001, "", "en", None, 0), (2002, " \t\n", "en", "s", 3), (2003, "long " * 30_000, "en", "s", 150_000), (None, "no id at all here", "en", "s", 16), (None, "no id at all here", "en", "s", 16), docs[3], (docs[4][0], "another text of that id", "en", "s", 5)]
    return spark.createDataFrame(docs + more, "doc_id long, text string, lang string, source string, n_chars long")


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_toxicity_stage(spark, fixture):
    """Rows go if the model's score of their text, computed alone, is 0.5 or more."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    score = fit_toxicity(fixture.select("doc_id", "text"), labels.select("doc_id", "toxic"), Workspace(spark, "t")).scorer()
    want = sorted(str(tuple(r)) for r in fixture.collect() if score(r.text) < 0.5)
    assert rows(corpus_pipeline.toxicity(spark, fixture, SF)) == want


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates_stage(spark, fixture):
    own = fixture.collect()
    sets = [shingles(r.text) for r in own]
    parent = {r.doc_id: r.doc_id for r in own if r.doc_id is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            if a.doc_id is not None and b.doc_id is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((root(a.doc_id), root(b.doc_id)))
                parent[y] = x
    kept: dict = {}
    for r in own:
        if r.doc_id is None:
            kept.setdefault(None, []).append(r)
        elif root(r.doc_id) == r.doc_id:
            kept[r.doc_id] = [min([*kept.get(r.doc_id, []), r], key=lambda x: tuple((v is not None, v.encode() if isinstance(v, str) else v or 0) for v in x[1:]))]
    want = sorted(str(tuple(r)) for v in kept.values() for r in v)
    assert rows(corpus_pipeline.near_duplicates(spark, fixture, SF)) == want
    assert len(want) < len(own) - 10


def test_decontamination_stage(spark, fixture):
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [(x, min(13, -(-len(x) * 4 // 5)), {w: [i for i, y in enumerate(x) if y == w] for w in x}) for x in items if len(x) >= 8]

    def found(text):
        own = words(text)
        for item, need, places in items:
            lines: dict[int, list[int]] = {}
            for p, w in enumerate(own):
                for q in places.get(w, ()):
                    lines.setdefault(p - q, []).append(q)
            for at in lines.values():
                at.sort()
                if any(at[i + need - 1] - at[i] < 60 for i in range(len(at) - need + 1)):
                    return True
        return False

    want = sorted(str(tuple(r)) for r in fixture.collect() if not found(r.text))
    got = corpus_pipeline.decontamination(spark, fixture, SF)
    assert rows(got) == want and len(want) <= fixture.count() - 3


def test_mixing_stage(spark, fixture):
    """Copies per source come near the target, in all and row by row; rows without words go."""
    own = [r for r in fixture.collect()]
    size = {}
    for r in own:
        size[r.source] = size.get(r.source, 0) + len(words(r.text))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        open_ = sum(weight[s] for s in size if s not in full)
        target = {s: 3 * size[s] if s in full else left * weight[s] / open_ for s in size}
        over = {s for s in size if s not in full and target[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    got = corpus_pipeline.mixing(spark, fixture, SF).collect()
    taken: dict = {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
    for s in size:
        most = max(len(words(r.text)) for r in own if r.source == s)
        # Rows equal in doc_id and text stand or fall together.
        assert abs(taken.get(s, 0) - target[s]) <= most, s
    count = {}
    for r in got:
        assert words(r.text)
        count[tuple(r)] = count.get(tuple(r), 0) + 1
    times = {}
    for r in own:
        times[tuple(r)] = times.get(tuple(r), 0) + 1
    assert all(n <= 3 * times[k] and n % times[k] == 0 for k, n in count.items())


def test_tokens_stage(spark, fixture):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.tokens(spark, fixture, SF).orderBy("start").collect()
    want = {}
    for r in fixture.collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have, at, last = {}, 0, None
    for r in got:
        assert r.start == at and (last is None or r.doc_id >= last)
        at, last = at + r.n_tokens, r.doc_id
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_clashing_columns(spark, fixture):
    """Columns that the operators use within come through untouched."""
    names = ["copies", "u", "key_", "row", "component_id", "item_id", "score", "h", "id"]
    df = fixture.limit(40).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "mixing":
            df = df.drop("copies")
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        assert out.count() >= 0
