import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kinetrace.llm.common import Workspace
from kinetrace.llm.tokenbin import BLOCK, ChunkEncoder, ShardWriter, decode_blocks, encode_blocks, read_shard, read_tokens, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("top", [1, 2, 300, 49_408, 2**32 - 1])
def test_blocks_round_trip(top):
    rng = np.random.default_rng(top)
    ids = rng.integers(0, top, 7 * BLOCK, dtype=np.uint32)
    ids[::37] = top - 1
    data, lengths = encode_blocks(ids)
    assert (decode_blocks(data, np.cumsum(lengths) - lengths) == ids).all()


def test_file_round_trip(tmp_path):
    docs = [(None, 3), (1, 0), (2, 5000), (2, 1), (9, 256), (10, 1_200_000)]
    rng = np.random.default_rng(0)
    docs = [(d, rng.integers(0, 50_000, n, dtype=np.uint32)) for d, n in docs]
    w = ShardWriter(f"{tmp_path}/x.pfor", 0.9)
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    got = list(read_shard(f"{tmp_path}/x.pfor"))
    assert [g[0] for g in got] == [d for d, _ in docs]
    assert all((g[2] == ids).all() for g, (_, ids) in zip(got, docs, strict=True))
    assert [g[1] for g in got] == [sum(len(x) for _, x in docs[:i]) for i in range(len(docs))]


def test_chunks_equal_whole_texts():
    whole, chunks = Tokenizer.from_file(PATH), ChunkEncoder(PATH)
    rng = random.Random(3)
    alphabet = list("abzABZ019 .,'-$\n\t\r\x0b\x85  ") + ["it's", "we'll", "é", "É", "ß", "ñ", "é", "́", "İ", "Σ", "ς", "µ", "ª", "²", "×", "日本", "👍🏽", "<|endoftext|>", "‍", "ﬁ", "\x00", "\x1c"]
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(0, 30)))
        assert np.frombuffer(chunks.encode(text), chunks.kind).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("stretch", [1, 40, 1 << 20])
def test_stretches_of_columns_equal_whole_texts(monkeypatch, stretch):
    """Texts that end within, at and beyond stretches, nulls and slices of columns."""
    from kinetrace.llm import tokenbin

    monkeypatch.setattr(tokenbin, "STRETCH", stretch)
    whole, chunks = Tokenizer.from_file(PATH), ChunkEncoder(PATH, 50)
    rng = random.Random(stretch)
    words = ["It's", "a", "B2b", "x3,5!", "ÀÉ", "×÷", "straße", "İI", "A\u0301b", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "日本", "\t", "\n", "", "o'Neill's", "K", "Ǻ", "ÿ", "Þ", "z" * 300]
    texts = [None if rng.random() < 0.1 else rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=rng.randrange(0, 25))) for _ in range(300)]
    column = pa.array(["dropped", *texts, None, ""])[1:]
    ids, ends, n = [], [], 0
    for got, at in chunks.stream(column):
        ids += got.tolist()
        ends += (at + n).tolist()
        n += len(got)
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in column.to_pylist()]
    assert ids == [x for w in want for x in w] and ends == np.cumsum([len(w) for w in want]).tolist()
    assert list(chunks.stream(pa.array([], pa.string()))) == []


def test_query_equals_brute_force(spark):
    whole = Tokenizer.from_file(PATH)
    rows = [(i * 7 % 50, ["A b c.", None, "", "word " * 5000, "Ünïcode tëxt\n" * 9][i % 5], "x") for i in range(60)] + [(None, "no id", "x"), (3, "A b c.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    work = Workspace(spark, "t")
    got = [tuple(r) for r in read_tokens(write_tokens(df, f"{work.path}/files", PATH, work=work)).orderBy("start").collect()]
    at, want = 0, []
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert read_tokens(write_tokens(df.limit(0), f"{work.path}/none", PATH, work=Workspace(spark, "t"))).count() == 0


def test_other_tokenizers_get_whole_texts(spark):
    """Byte-level BPE keeps white space, so texts can't be cut into chunks."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, chunks = Tokenizer.from_file(path), ChunkEncoder(path)
    for text in ["", "Hello  world\n\n it's 12345", "Ünïcode tëxt 日本", " lead", "word " * 3000]:
        assert np.frombuffer(chunks.encode(text), chunks.kind).tolist() == whole.encode(text, add_special_tokens=False).ids
    df = spark.createDataFrame([(2, "Hello  world"), (1, None)], "doc_id long, text string")
    work = Workspace(spark, "t")
    got = read_tokens(write_tokens(df, f"{work.path}/files", path, work=work)).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(1, 1), (2, len(whole.encode("Hello  world", add_special_tokens=False).ids) + 1)]


def test_repeated_ids_are_dealt_out(spark):
    """Many texts of one doc_id don't gather in one file, and keep one order."""
    rows = [(7, f"text number {i}") for i in range(400)] + [(3, "first"), (9, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    work = Workspace(spark, "t")
    manifest = write_tokens(df, f"{work.path}/files", PATH, work=work)
    assert max(r.n_docs for r in manifest.collect()) < 300
    got = [tuple(r) for r in read_tokens(manifest).orderBy("start").collect()]
    again = Workspace(spark, "t")
    assert got == [tuple(r) for r in read_tokens(write_tokens(df.repartition(3), f"{again.path}/files", PATH, work=again)).orderBy("start").collect()]
    assert got[0][0] == 3 and got[-1][0] == 9
