"""All queries of the core run over the smallest tables and, where they have SQL, equal it."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from gleanery.plans.registry import QUERIES, SQL
import gleanery.queries  # noqa: F401


def value(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return f"{x:.6g}"
    return str(x.isoformat() if hasattr(x, "isoformat") else x).replace("T00:00:00", "")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        r = duck.execute(SQL[name])
        assert got == rows([c[0] for c in r.description], r.fetchall())


def test_contract(spark, small):
    assert set(SQL) <= set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns


def test_a_broken_subpackage_leaves_the_core(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "gleanery.llm", None)
    monkeypatch.delitem(sys.modules, "gleanery.llm.queries", raising=False)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)


def test_a_cluster_needs_a_shared_folder():
    from gleanery.session import is_local

    assert is_local("local") and is_local("local[8]") and not is_local("local-cluster[3,2,3000]") and not is_local("spark://host:7077") and not is_local("yarn")
