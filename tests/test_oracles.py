"""Every query with an oracle equals DuckDB on a small scale factor; the rest run."""

import os

import duckdb
import pytest

import __spark_entry__
from kinetrace.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(v[i] for i in order)) for v in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert got == rows(want.columns, want.fetchall())
    assert got


def test_entry(spark, monkeypatch):
    assert __spark_entry__.entry(spark).count() == 16


def test_no_python_in_core_plans(spark):
    for name in ("temporal_stats", "flat_stats", "clutch_filter", "rel_xyz_rot6d", "merge_quantiles", "ranked_percentiles"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow")), name


def test_entry_without_llm(monkeypatch):
    import builtins

    real = builtins.__import__

    def blocked(name, *args, **kwargs):
        if name.startswith("kinetrace.llm"):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", blocked)
    assert set(__spark_entry__.queries()) == set(QUERIES)
