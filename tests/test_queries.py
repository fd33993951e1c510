"""Registered graph queries against their SQL, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quillgraph.plans import queries as graph

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(pdf):
    cols = sorted(pdf.columns)
    flat = lambda v: "null" if pd.isna(v) else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(flat(v.item() if hasattr(v, "item") else v) for v in r) for r in pdf[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(graph.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got, want = graph.QUERIES[name](spark, DATA).toPandas(), duck.sql(graph.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_linkpred_auc_asks_for_a_negative_an_edge(spark, monkeypatch):
    asked, real = [], graph.linkpred.negatives
    monkeypatch.setattr(graph.linkpred, "negatives", lambda g, n: asked.append((g.count(), n)) or real(g, n))
    assert 0 <= graph.QUERIES["linkpred_auc"](spark, DATA).collect()[0]["auc"] <= 1
    assert len(asked) == 1 and asked[0][0] == asked[0][1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
