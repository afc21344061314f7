"""Every registered query against its SQL, and what its plan must not contain."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from conftest import DATA
from shoalmark.plans import catalog

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"]

QUERIES, ORACLE = catalog.QUERIES, catalog.ORACLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(DATA, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def table(rows, cols):
    """Rows in a fixed order, columns by name; doubles as they are."""
    order = [cols.index(c) for c in sorted(cols)]
    out = [tuple(r[i] for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r))


def same(x, y):
    if isinstance(x, float) and isinstance(y, (int, float)):
        return x == pytest.approx(y, rel=1e-9, abs=2e-6)
    return x == y


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, data_dir, name):
    df = QUERIES[name](spark, data_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in FORBIDDEN:
        assert node not in plan, node
    rows = [tuple(r) for r in df.collect()]
    final = df._jdf.queryExecution().executedPlan().toString()
    for node in FORBIDDEN:
        assert node not in final, node
    cur = duck.execute(ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    got, want = table(rows, df.columns), table(cur.fetchall(), cols)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_contract_has_every_query():
    assert QUERIES.items() <= contract.queries().items() and ORACLE.items() <= contract.oracle_sql().items()


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.columns[:2] == ["species", "year"] and df.count() > 0
