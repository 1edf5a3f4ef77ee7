"""Every registered relational query runs, and agrees with DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from siltstone.plans import registry, views

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(value):
    if value is None or value != value:
        return None
    return f"{float(value):.5f}" if isinstance(value, (int, float)) and not isinstance(value, bool) or hasattr(value, "as_tuple") else str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_duckdb(spark, name):
    frame = registry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    ours = sorted(str([plain(r[c]) for c in columns]) for r in frame.collect())
    con = duckdb.connect()
    for table in views.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = con.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    assert ours == theirs
