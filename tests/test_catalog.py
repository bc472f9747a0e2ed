"""Every named query runs; those with SQL must give the rows DuckDB gives."""

import pytest

from evigraph.plans import catalog
from evigraph.session import TABLES
from tools.compare import compare

REGISTRY = catalog.load()
BRUTE_FORCE = set()


@pytest.fixture(scope="module")
def oracle(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def test_only_inexpressible_queries_lack_sql():
    assert {n for n, q in REGISTRY.items() if q.sql is None} == BRUTE_FORCE


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, oracle, data, name):
    state, rows, _, note = compare(spark, oracle, REGISTRY[name], data)
    assert state in ("ok", "rows"), note
    assert "TYPES" not in note
