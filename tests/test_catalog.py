"""Every registered query with SQL gives what DuckDB gives over the smallest tables."""

import math
import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from docquarry.operators import align
from docquarry.plans import catalog, workflows

SQL, QUERIES = catalog.SQL | workflows.SQL, catalog.QUERIES | workflows.QUERIES

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    own = Counter(repr(tuple(plain(r[c]) for c in sorted(columns))) for r in df.collect())
    other = Counter(repr(tuple(plain(r[columns.index(c)]) for c in sorted(columns))) for r in result.fetchall())
    assert own == other


def test_names():
    assert set(SQL) <= set(QUERIES) and not set(catalog.QUERIES) & set(workflows.QUERIES)


def test_legacy_alignment_looks_into_other_documents(spark):
    left, right = catalog.recs(spark, str(DATA)), catalog.resps(spark, str(DATA))
    rows = align.nested(align.top_three(left, right, least=0.1), left).collect()
    assert any(not r.responses[0].same_document for r in rows if r.responses)
    assert {r.alignment_status for r in rows} >= {"Direct response", "Uncertain"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert len(set(df.columns)) == len(df.columns) and df.count() >= 0
