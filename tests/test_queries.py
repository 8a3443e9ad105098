"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, duck

import __spark_entry__ as entry
from marketloom.catalog import REGISTRY


@pytest.fixture(scope="module")
def con(root):
    return duck(root)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, root, name):
    query = REGISTRY[name]
    if query.sql is None:
        assert query.run(spark, root).columns
        return
    ok, note = compare(spark, con, query.run, query.sql, root)
    assert ok, note


def test_entry_points(spark):
    rows = entry.entry(spark).collect()
    assert sorted(r["position"] for r in rows) == list(range(1, len(rows) + 1))
    assert set(entry.oracle_sql()) <= set(entry.queries())
