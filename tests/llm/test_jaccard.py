import random
import re
from itertools import combinations

import numpy as np
import pytest

from kinetrace.llm.jaccard import bit_sketch, folded, jaccard_components, part_keys, spread

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, (a, _)), (j, (b, _)) in combinations(enumerate(rows), 2):
        if a is None or b is None or not sets[i] or not sets[j]:
            continue
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return sorted((str(d), len(s), str(None if d is None else root(d))) for (d, _), s in zip(rows, sets, strict=True))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("abcdefghijklmnop") * 3
    return words


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(1, 5)))
    texts = []
    common = [word() for _ in range(40)]
    for n in [3, 4, 5, 6, 8, 11, 30, 66, 70, 90, 150, 300, 600]:
        base = [word() for _ in range(n)]
        texts.append(" ".join(base))
        for e in (0, 0, 1, 1, 2, 3, n // 40, n // 30, n // 25):
            texts.append(" ".join(edited(rng, base, e)))
        texts.append(" ".join(base + [word() for _ in range(n // 5)]))
        texts.append(" ".join(base[: n * 4 // 5 + 2]).upper())
    # Many documents with one passage, and a large group of near copies.
    texts += [" ".join(common + [word() for _ in range(rng.randrange(5, 80))]) for _ in range(60)]
    base = [word() for _ in range(120)]
    texts += [" ".join(edited(rng, base, 3)) for _ in range(80)]
    texts += [None, "", " \n\t", "one", "one", "One", "ONE two", "\xa0", "a\x0bb", "word " * 2000, "Ünï Ünï"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    return [*rows, rows[3], (None, "one"), (None, None), (rows[5][0], "another text of that id altogether")]


@pytest.mark.parametrize("seed, hot", [(1, 16), (2, 16), (2, 2)])
def test_components_equal_brute_force(spark, seed, hot):
    """With hot = 2, a part sketch that more than four sets emit is dealt out by holder."""
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, rep string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_components(df, hot=hot).collect())
    assert got == brute(rows)


def test_empty_and_unlinked(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(empty).collect() == []
    got = jaccard_components(spark.createDataFrame([(1, None), (2, "a b c"), (3, "d e f")], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1), (2, 1, 2), (3, 1, 3)]


def hamming(a, b):
    a, b = (np.frombuffer(bit_sketch(x), "<u8")[None] for x in (a, b))
    words = min(a.shape[1], b.shape[1])
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_sketch_bounds(percent):
    """The Hamming distance never exceeds the difference, and similar sets share one of their first d + 1 part sketches."""
    rng = np.random.default_rng(0)
    first = lambda x: [np.sort(keys)[: len(x) * (100 - percent) // percent + 1] for keys in part_keys(x, percent, spread(percent))]
    for n in (1, 5, 62, 70, 126, 500, 3000):
        for damage in (0, 1, n // 20, n // 9):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            gone = rng.permutation(len(a))[:damage]
            b = np.unique(np.concatenate((np.delete(a, gone), rng.integers(0, 2**63, damage + n // 30, dtype=np.uint64))))
            if not len(b):
                continue
            assert hamming(a, b) <= len(np.setxor1d(a, b))
            same, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if 100 * same >= percent * union:
                assert np.intersect1d(np.concatenate(first(a)), np.concatenate(first(b))).size
