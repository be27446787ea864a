from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinetrace.llm.mixing import pareto_mix, source_targets

SCHEMA = "doc_id long, text string, source string, size string, copies int"


def corpus(spark, n=900):
    rows = [(i, "w " * (1 + i * 7919 % 400), [None, "a", "b", "ä", "Z"][0 if i % 3 == 0 else 1 + i % 4], "x", 1) for i in range(n)]
    return spark.createDataFrame([*rows, (None, "one two", "a", "x", 1), (5, None, "b", "x", 1), (5, "", "b", "x", 1), rows[7], (6, " \t\n", None, "x", 1)], SCHEMA)


def water(sizes, most=3):
    """Excess reshared round by round until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        w = sum(weight[s] for s in sizes if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / w for s in sizes}
        over = {s for s in sizes if target[s] > most * sizes[s] and s not in full}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 100, "c": 1, None: 50}, {"a": 0, "b": 7}, {"x": 5}, {"a": 1, "b": 1, "c": 1000, "d": 3, "e": 2}])
def test_targets_equal_resharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = water(sizes)
    for r in source_targets(df).collect():
        assert abs(r.target - want[r.source]) < 1e-6, (r, want)


def test_mix(spark):
    got = pareto_mix(corpus(spark)).collect()
    assert len(got) == 905
    taken, target, size, most = defaultdict(int), {}, {}, defaultdict(int)
    for r in got:
        assert r.taken == r.size * r.copies and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source], size[r.source] = r.target, r.source_size
        most[r.source] = max(most[r.source], r.size)
    assert target == pytest.approx(water(size))
    for s in target:
        assert abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6
    key = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert key(got) == key(pareto_mix(corpus(spark).repartition(7)).collect())
    assert {r.copies for r in got if not r.size} == {0}


def test_bins_do_not_matter(spark):
    key = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert key(pareto_mix(corpus(spark), bins=1).collect()) == key(pareto_mix(corpus(spark)).collect())


def test_importance_makes_inclusion_unequal(spark):
    df = corpus(spark, 3000).withColumn("importance", F.when(F.col("doc_id") % 2 == 0, 3.0).when(F.col("doc_id") % 5 == 0, None).otherwise(1.0))
    got = pareto_mix(df, importance="importance").where("size > 0 and source is null and doc_id is not null")
    rows = got.collect()
    mean = lambda f: sum(r.copies for r in rows if f(r.doc_id)) / sum(f(r.doc_id) for r in rows)
    even, odd, none = mean(lambda i: i % 2 == 0), mean(lambda i: i % 2 and i % 5), mean(lambda i: i % 2 and i % 5 == 0)
    assert even > 2 * odd > 0 and none == 0
    assert abs(sum(r.taken for r in rows) - rows[0].target) <= 400


def test_pareto_order_equals_brute_force(spark):
    """One source of known target: the taken rows are the prefix of the Pareto order, row by row."""
    import hashlib

    rows = [(i, "w " * (1 + i * 31 % 90), ("a", "b")[i % 4 == 0]) for i in range(400)]
    imp = lambda size: 1.0 if size < 30 else 2.5
    got = pareto_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), importance=lambda n: F.when(n < 30, 1.0).otherwise(2.5)).collect()
    for source in "ab":
        own = [r for r in got if r.source == source]
        low, high = 0.0, 10.0
        for _ in range(200):
            rate = (low + high) / 2
            low, high = (rate, high) if sum(r.size * min(3.0, rate * imp(r.size)) for r in own) < own[0].target else (low, rate)
        text = {i: t for i, t, _ in rows}
        order, room = [], own[0].target
        for r in own:
            expected = min(3.0, rate * imp(r.size))
            whole = int(expected + 1e-9)
            room -= whole * r.size
            p = expected - whole
            if p > 1e-6:
                digest = hashlib.md5(f"7:{r.doc_id}:{hashlib.md5(text[r.doc_id].encode()).hexdigest()}".encode()).hexdigest()
                u = (int(digest[:13], 16) + 0.5) / 2**52
                order.append((u / (1 - u) * (1 - p) / p, r, whole))
            else:
                assert r.copies == whole
        at = 0
        for _, r, whole in sorted(order, key=lambda x: x[0]):
            assert r.copies == whole + (2 * at + r.size <= 2 * room + 1e-6), (source, r)
            at += r.size
        assert len(order) > 50


def test_columns_stay(spark):
    df = corpus(spark, 50).withColumnRenamed("copies", "u").withColumn("key_", F.lit(2))
    kept = pareto_mix(df, keep=True)
    assert kept.columns == [*df.columns, "copies", "taken"] and kept.drop("copies", "taken").exceptAll(df).count() == 0
    plain = pareto_mix(df)
    assert sorted(str((r.doc_id, r.taken)) for r in kept.collect()) == sorted(str((r.doc_id, r.taken)) for r in plain.collect())


def test_long_text(spark):
    got = pareto_mix(spark.createDataFrame([(1, "word " * 300_000, "a"), (2, "x", "b")], "doc_id long, text string, source string")).collect()
    assert {r.doc_id: r.size for r in got} == {1: 300_000, 2: 1}


def test_empty_table(spark):
    assert pareto_mix(spark.createDataFrame([], SCHEMA)).collect() == []
