import random

from kinetrace.llm.decontam import contaminated_spans, decontaminate

RNG = random.Random(8)
WORDS = ["".join(RNG.choices("abcdefghijklmnopqrst", k=RNG.randrange(2, 7))) for _ in range(3000)]


def text(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def tables(spark):
    items = [(i, text(n)) for i, n in enumerate([15, 20, 40, 59, 8, 10, 12, 7])]
    docs, want = [], set()
    for d in range(40):
        docs.append((d, text(RNG.randrange(1, 400))))
    for i, words in items[:7]:
        d = len(docs)
        docs.append((d, text(50) + [w.upper() for w in words] + text(30)))
        want.add((d, i))
    for i, words in items[1:4]:
        d, own = len(docs), list(words)
        for at in range(3, len(own), 6):
            own[at] = "changed"
        docs.append((d, text(5) + own + text(5)))
        want.add((d, i))
    half = items[3][1][:8]
    docs.append((len(docs), text(40) + half + text(40)))
    docs.append((len(docs), items[7][1]))
    rows = [(d, " ".join(w), "x", 0) for d, w in docs] + [(None, " ".join(items[2][1]), "x", 0), (500, None, "x", 0), (501, "", "x", 0)]
    rows.append(next(r for r in rows if r[0] == 40))
    return spark.createDataFrame(rows, "doc_id long, text string, item_id string, n int"), spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(None, None), (99, "")], "item_id long, text string"), want


def test_items_are_found(spark):
    docs, bench, want = tables(spark)
    got = [(r.doc_id, r.item_id) for r in contaminated_spans(docs, bench).collect()]
    assert set(got) == want | {(None, 2)} and got.count((40, 0)) == 2
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    gone = {d for d, _ in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id not in gone and r.doc_id is not None)


def test_passes_do_not_matter(spark, monkeypatch):
    from kinetrace.llm import decontam

    docs, bench, want = tables(spark)
    monkeypatch.setattr(decontam, "PASS_WORDS", 60)
    assert {(r.doc_id, r.item_id) for r in contaminated_spans(docs, bench).collect()} == want | {(None, 2)}


def test_empty_tables(spark):
    docs, bench, _ = tables(spark)
    assert contaminated_spans(docs.limit(0), bench).collect() == []
    assert contaminated_spans(docs, bench.limit(0)).collect() == []
    assert decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_edited_items_equal_brute_force():
    import itertools

    import pyarrow as pa

    from kinetrace.llm.decontam import EXTENT, MIN_ITEM, Benchmark, needed

    rng = random.Random(4)
    items = [(i, [rng.choice(WORDS) for _ in range(n)]) for i, n in enumerate([*range(7, 22), 30, 45, 59, 60, 61, 90])]
    docs = []
    for _, words in items:
        n = len(words)
        edits = [(), *((i,) for i in range(n)), *itertools.combinations(range(n), 2)] if n <= 20 else [()]
        edits += [rng.sample(range(n), k) for k in range(3, n - 7) for _ in range(30 if n < 30 else 6)]
        for gone in edits:
            own = ["changed" if i in set(gone) else w for i, w in enumerate(words)]
            docs.append([rng.choice(WORDS) for _ in range(rng.randrange(4))] + own + [rng.choice(WORDS) for _ in range(rng.randrange(4))])
    # Cut off by the ends of texts.
    docs += [words[k:] for _, words in items for k in (1, 3, 6)] + [words[:-k] for _, words in items for k in (1, 3, 6)]
    want = set()
    for d, words in enumerate(docs):
        for i, own in items:
            if len(own) < MIN_ITEM:
                continue
            for x in range(-len(own), len(words) + 1) if set(own) & set(words) else ():
                same = [j for j in range(len(own)) if 0 <= j + x < len(words) and own[j] == words[j + x]]
                m = needed(len(own))
                if any(same[j + m - 1] - same[j] < EXTENT for j in range(len(same) - m + 1)):
                    want.add((d, i))
    bench = Benchmark([(i, " ".join(w)) for i, w in items])
    got = list(bench.scan(pa.array([" ".join(w) for w in docs])))
    assert len(got) == len(want) and {(d, i) for d, i, *_ in got} == want
    for d, i, start, end, matches in got:
        assert matches >= needed(len(items[i][1])) and 0 <= start < end <= len(docs[d]) and matches <= end - start


def brute(words, item):
    """Most matches within 60 consecutive words of the item, over all diagonals."""
    best = 0
    for d in range(1 - len(item), len(words)):
        same = [0 <= d + i < len(words) and words[d + i] == w for i, w in enumerate(item)]
        best = max([best, *(sum(same[i : i + 60]) for i in range(max(1, len(same) - 59)))])
    return best


def test_query_equals_brute_force(spark):
    """Random substitutions, cuts and joins of items in texts: exactly the pairs that meet the stated bound."""
    rng = random.Random(4)
    items = [(i, [rng.choice(WORDS[:200]) for _ in range(n)]) for i, n in enumerate([8, 9, 10, 11, 12, 13, 14, 15, 17, 20, 25, 40, 61, 90, 7, 5])]
    docs = []
    for d in range(260):
        own = [rng.choice(WORDS[:200]) for _ in range(rng.randrange(0, 60))]
        _, item = items[rng.randrange(len(items))]
        low = rng.randrange(0, max(1, len(item) // 3)) if rng.random() < 0.4 else 0
        part = [rng.choice(WORDS[:200]) if rng.random() < 0.25 * (d % 3) / 2 else w for w in item[low:]]
        docs.append((d, [*own, *part, *(rng.choice(WORDS[:200]) for _ in range(rng.randrange(0, 30)))]))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matches for r in contaminated_spans(df, bench, shortest=5).collect()}
    want = {}
    for d, words in docs:
        for i, item in items:
            n = len(item)
            if brute(words, item) >= (n if n < 8 else min(13, -(-n * 4 // 5))):
                want[d, i] = True
    assert set(got) == set(want) and len(want) > 100
    default = {(r.doc_id, r.item_id) for r in contaminated_spans(df, bench).collect()}
    assert default == {(d, i) for d, i in want if len(items[i][1]) >= 8}


def test_long_text(spark):
    words = text(60_000)
    bench = spark.createDataFrame([(1, " ".join(words[59_000:59_030])), (2, " ".join(text(30)))], "item_id long, text string")
    got = contaminated_spans(spark.createDataFrame([(5, " ".join(words))], "doc_id long, text string"), bench).collect()
    assert [(r.doc_id, r.item_id, r.start_word, r.end_word) for r in got] == [(5, 1, 59_000, 59_030)]
