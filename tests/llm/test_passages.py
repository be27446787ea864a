import random

import numpy as np
import pyarrow as pa
import pytest

from kinetrace.llm.passages import K, _seeds, chains, repeated_passages

RNG = random.Random(11)
WORDS = ["".join(RNG.choices("abcdefghijklmnopqrstuv", k=RNG.randrange(2, 8))) for _ in range(4000)]


def text(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def run(spark, docs):
    rows = [(d, None if w is None else " ".join(w), "x") for d, w in docs]
    return repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, chain string")).collect()


def test_planted_passages(spark):
    docs = [(d, text(RNG.randrange(1, 300))) for d in range(60)]
    exact, fuzzy, hot, short = text(60), text(100), text(55), text(40)
    inserted = list(fuzzy)
    for at in (80, 60, 35, 12):
        inserted[at : at + 1] = ["new", "words"] if at != 35 else []
    plant = lambda p: text(RNG.randrange(0, 90)) + p + text(RNG.randrange(0, 90))
    docs += [(100, plant(exact)), (101, plant([w.upper() for w in exact]))]
    docs += [(110, plant(fuzzy)), (111, plant(inserted))]
    docs += [(200 + i, plant(hot)) for i in range(30)]
    docs += [(300, plant(short)), (301, plant(short))]
    docs += [(400, docs[7][1]), (None, exact), (500, None), (501, []), (502, exact[:1]), (100, docs[60][1])]
    got = run(spark, docs)
    ids = {frozenset((r.doc_id, r.source_doc_id)) for r in got}
    assert frozenset((100, 101)) in ids and frozenset((110, 111)) in ids
    assert {x for s in ids for x in s} >= {200 + i for i in range(30)}
    assert not {x for s in ids for x in s} & {300, 301, None, 500, 501, 502}
    long = {7, 400} if len(docs[7][1]) >= 50 else set()
    assert {x for s in ids for x in s} == {100, 101, 110, 111, *range(200, 230), *long}
    words = dict(docs[:-1])
    for r in got:
        if {r.doc_id, r.source_doc_id} == {100, 101}:
            own = [w.lower() for w in words[r.doc_id][r.start_word : r.end_word]]
            assert len(own) == 60 and own == [w.lower() for w in words[r.source_doc_id][r.source_start : r.source_end]]
    assert len(got) == len(ids)


def test_empty_table(spark):
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_seeds_do_not_hang_on_their_surroundings():
    """A stretch gives the same seeds wherever it stands, about every other place."""

    def seeds(words):
        (batch,) = _seeds(1)([pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([" ".join(words)])], names=["id", "text"])])
        return dict(zip(np.frombuffer(batch.column(3)[0].as_py(), np.int32).tolist(), np.frombuffer(batch.column(1)[0].as_py(), np.uint64).tolist(), strict=True))

    part = text(400)
    x, y = seeds(text(30) + part + text(9)), seeds(text(77) + part)
    inner = lambda s, at: {p - at: k for p, k in s.items() if at <= p <= at + len(part) - K}
    assert inner(x, 30) == inner(y, 77) and 150 < len(inner(x, 30)) < 250


def test_parts_held_by_smaller_ids(spark):
    shared = text(60)
    docs = [(1, text(80) + shared[:34] + text(9)), (2, shared[26:] + text(70)), (10, text(20) + shared + text(20)), (11, text(33) + shared)]
    got = run(spark, docs)
    assert (11, 10) in {(r.doc_id, r.source_doc_id) for r in got if r.matches >= 60}


def every_nth(words, n):
    return [w + "x" if i % n == n - 1 else w for i, w in enumerate(words)]


def test_edited_passage_whose_parts_smaller_ids_hold(spark):
    """Documents 1 to 3 hold parts of what 10 and 11 share with edits; each is too short to be a passage."""
    part = text(100)
    holders = [(1, text(30) + part[:40] + text(9)), (2, text(12) + part[33:73]), (3, part[66:] + text(70))]
    pair = [(10, text(20) + part + text(20)), (11, text(33) + every_nth(part, 12) + text(5))]
    assert {(r.doc_id, r.source_doc_id) for r in run(spark, pair)} == {(11, 10)}
    assert {(r.doc_id, r.source_doc_id) for r in run(spark, holders + pair)} == {(11, 10)}


def test_edited_passages_among_partial_holders(spark):
    """Pairs in groups, with holders of overlapping parts below, between and above their ids; no part gives a row."""
    rng = random.Random(21)
    docs, want, ids = [], set(), iter(range(10_000))
    for i in range(100):
        part = text(rng.randrange(80, 120))
        pieces = [part[a : a + 38] for a in range(0, len(part), 19)]
        low, mid, high = pieces[::3], pieces[1::3], pieces[2::3]
        if i % 2:
            low, mid = low + mid, []
        docs += [(next(ids), text(rng.randrange(40)) + x + text(rng.randrange(40))) for x in low]
        one = next(ids)
        docs.append((one, text(9) + part + text(20)))
        docs += [(next(ids), x + text(rng.randrange(40))) for x in mid]
        two = next(ids)
        docs.append((two, text(30) + every_nth(part, 12)))
        docs += [(next(ids), text(rng.randrange(40)) + x) for x in high]
        want.add((two, one))
    got = {(r.doc_id, r.source_doc_id) for r in run(spark, docs)}
    print(len(got & want), len(want))
    assert got <= want and len(got & want) >= 95


def test_many_edited_copies_meet_one_another(spark):
    """Every edited copy is linked with another one, by one or two rows, though smaller ids hold parts of it."""
    rng = random.Random(8)
    part = text(90)
    docs = [(i, text(5) + part[a : a + 36] + text(9)) for i, a in enumerate(range(0, 90, 18))]
    docs += [(100 + i, text(rng.randrange(60)) + edited(rng, part, 0.05) + text(rng.randrange(60))) for i in range(60)]
    got = run(spark, docs)
    assert {x for r in got for x in (r.doc_id, r.source_doc_id)} >= set(range(100, 160))
    assert all(r.doc_id >= 100 and r.source_doc_id >= 100 for r in got)


def test_texts_of_one_id(spark):
    one, two = text(60), text(70)
    docs = [(5, text(10) + one), (5, two + text(10)), (9, text(4) + one), (7, two), (8, one + two), (8, one + text(3))]
    got = {(r.doc_id, r.source_doc_id, r.end_word - r.start_word) for r in run(spark, docs)}
    assert {(9, 5, 60), (7, 5, 70)} <= {(max(a, b), min(a, b), n) for a, b, n in got} | {(7, 5, n) for a, b, n in got if {a, b} == {5, 7}}
    assert all(a != b for a, b, _ in got) and {a for a, _, _ in got} | {b for _, b, _ in got} == {5, 7, 8, 9}


def test_long_text(spark):
    part = text(80)
    got = run(spark, [(1, text(40_000) + part + text(20_000)), (2, text(70) + part)])
    assert [(r.doc_id, r.source_doc_id, r.source_start) for r in got] == [(2, 1, 40_000)]


def edited(rng, words, rate, every=None):
    return [("x" + w if ((i % every == every - 1) if every else rng.random() < rate) else w) for i, w in enumerate(words)]


@pytest.mark.parametrize("n, rate, every, least", [(60, 0.05, None, 0.97), (100, 0.10, None, 0.97), (60, 0.10, None, 0.85), (100, 0.15, None, 0.9), (60, None, 12, 0.85), (100, None, 8, 0.9)])
def test_edited_passages(spark, n, rate, every, least):
    """Shares of 200 edited copies, among unrelated texts, that are found; the README lists them."""
    rng = random.Random(n)
    docs = []
    for i in range(200):
        part = text(n)
        docs += [(2 * i, text(rng.randrange(80)) + part + text(rng.randrange(80))), (2 * i + 1, text(rng.randrange(80)) + edited(rng, part, rate, every) + text(rng.randrange(80)))]
    got = {(r.source_doc_id, r.doc_id) for r in run(spark, docs)}
    found = sum((2 * i, 2 * i + 1) in got for i in range(200)) / 200
    print(n, rate, every, found)
    assert found >= least and all(b == a + 1 and a % 2 == 0 for a, b in got)


def test_chains_equal_quadratic_search():
    rng = np.random.default_rng(3)
    from kinetrace.llm.passages import GAP_COST

    for _ in range(30):
        n = 25
        p, q = np.sort(rng.integers(0, 120, n)), rng.integers(0, 120, n)
        order = np.lexsort((q, p))
        p, q = p[order], q[order]
        best = np.zeros(n)
        for i in range(n):
            best[i] = K + max([0.0] + [best[j] - GAP_COST * (p[i] - p[j] + q[i] - q[j]) for j in range(n) if p[j] < p[i] and q[j] < q[i]])
        got = chains(p, q)
        top = int(np.argmax(best))
        if got and best[top] > K:
            value = lambda c: K * len(c) - GAP_COST * (p[c[-1]] - p[c[0]] + q[c[-1]] - q[c[0]])
            assert all((np.diff(p[c]) > 0).all() and (np.diff(q[c]) > 0).all() for c in got)
            assert max(value(c) for c in got) <= best[top] + 1e-9


def exact_places(docs):
    """By brute force: places of the 50-grams that stand in another document too, and the smallest document of each."""
    held = {}
    for d, words in docs:
        for i in range(len(words) - 49):
            held.setdefault(tuple(words[i : i + 50]), []).append((d, i))
    return {(d, i) for at in held.values() for d, i in at if d != min(at)[0]}


def test_every_exact_repeat_is_found(spark):
    rng = random.Random(5)
    source = [rng.choice(WORDS) for _ in range(600)]
    docs = []
    for d in range(400):
        at, n = rng.randrange(530), rng.randrange(55, 71)
        words = text(rng.randrange(30)) + source[at : at + n] + text(rng.randrange(30))
        if d % 10 == 0:
            # Twice, and parts of one stretch twice over.
            at = rng.randrange(500)
            words += source[at : at + 60] + text(3) + source[at + 20 : at + 80] + text(5) + source[at : at + 60]
        docs.append((d, words))
    docs += [(500 + n, text(5) + ["same"] * n + text(5)) for n in (50, 55, 130, 400)]
    got = run(spark, docs)
    covered = {}
    for r in got:
        covered.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
        assert r.matches >= 0.8 * max(r.end_word - r.start_word, r.source_end - r.source_start)
    want = exact_places(docs)
    words = {(d, i + j) for d, i in want for j in range(50)}
    assert not {(d, w) for d, w in words if not any(a <= w < b for a, b in covered.get(d, []))}
    assert len(got) < 12 * len(docs)
