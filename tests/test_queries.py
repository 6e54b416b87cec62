"""Every query that has SQL gives what DuckDB gives for it on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from ticktide.plans import registry

TABLES, LARGER = Path("/root/testdata/sf0.001"), Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return repr(value + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, str(TABLES))
    columns = sorted(found.columns)
    asked = duck.execute(registry.ORACLE_SQL[name])
    at = {c[0]: i for i, c in enumerate(asked.description)}
    assert sorted(at) == columns
    want = sorted(tuple(plain(r[at[c]]) for c in columns) for r in asked.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in found.collect()) == want


@pytest.mark.skipif(not LARGER.exists(), reason="needs the test tables")
def test_every_sql_gives_rows_on_larger_tables():
    con = duckdb.connect(config={"threads": 2})
    for path in LARGER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    assert [n for n, text in registry.ORACLE_SQL.items() if con.execute(text).fetchone() is None] == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, str(TABLES)).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
