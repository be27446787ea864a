import numpy as np
import pytest

from kinetrace.llm.topk import Block, top_products


def brute(rows, k=5):
    ok = [(i, np.floor(np.array(v, np.float32).astype(float) * 256).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in {i: v for i, v in ok if i % 50 == 0}.items():
        got = sorted(((-int(v @ w), i) for i, w in ok if i != q and len(w) == len(v)))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(got)}
    return sorted(out)


@pytest.mark.parametrize("scale", [0.02, 0.4, 30.0])
def test_equals_brute_force(spark, scale):
    rng = np.random.default_rng(1)
    rows = [(int(i), (rng.normal(size=8) * scale).astype(np.float32).tolist()) for i in rng.permutation(600)]
    rows += [(1000, None), (1050, [None] * 8), (1100, [float("nan")] * 8), (1101, [float("inf")] + [9.0] * 7), (None, [9.0] * 8), (1103, []), (-50, rows[3][1])]
    rows += [(2000, [1.0, 2.0]), (2001, [3.0, 1.0])]
    # Ties: equal vectors.
    rows += [(3000 + i, rows[0][1]) for i in range(7)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    assert sorted(tuple(r) for r in top_products(df).collect()) == brute(rows)


def test_small_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert top_products(spark.createDataFrame([], schema)).collect() == []
    assert top_products(spark.createDataFrame([(0, [1.0])], schema)).collect() == []
    assert [tuple(r) for r in top_products(spark.createDataFrame([(0, [1.0]), (1, [0.5])], schema)).collect()] == [(0, 1, 1, 256 * 128)]


def test_repeated_rows_are_found_as_often(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    got = [tuple(r) for r in top_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 65536), (0, 2, 1, 65536), (0, 3, 2, 0)]


def test_slices_add_up():
    rng = np.random.default_rng(5)
    rows = rng.integers(-300, 300, (130, 6))
    block = Block.read(*Block.of(np.arange(130), rows.astype(np.int64)).row())
    q = np.array([3, -7, 0, 255, -256, 1])
    acc = block.scores(q)
    total = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(object) << i for i, s in enumerate(acc))
    above = rows - rows.min(0)
    want = np.where(q >= 0, above, 2**block.bits - 1 - above) @ np.abs(q)
    assert (total == want).all()


def test_components_are_doubles(spark):
    """1 - 1e-12 scales to 255, though its nearest float is 1."""
    rows = [(0, [1.0 - 1e-12, 0.0]), (1, [1.0, 0.0])]
    got = top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 255 * 256)]


def test_large_sums_are_exact_or_an_error(spark):
    schema = "vec_id long, embedding array<double>"
    got = top_products(spark.createDataFrame([(0, [2.0**20, -1.0]), (1, [2.0**20, 2.0])], schema)).collect()
    assert [r.score for r in got] == [2**56 - 2 * 2**16]
    with pytest.raises(Exception, match="64 bits|64-bit"):
        top_products(spark.createDataFrame([(0, [3e9]), (1, [3e9])], schema)).collect()


def test_best_rows_over_blocks():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(300, 5))
    query = np.floor(rows[7] * 256).astype(np.int64)
    scaled = np.floor(rows * 256).astype(np.int64)
    blocks = [Block.of(np.arange(i, i + 30), scaled[i : i + 30]) for i in range(0, 300, 30)]
    got = sorted((x for b in blocks for x in b.top(query, 7, 5)), key=lambda x: (-x[0], x[1]))[:5]
    want = sorted(((int(v @ query), i) for i, v in enumerate(scaled) if i != 7), key=lambda x: (-x[0], x[1]))[:5]
    assert got == want
