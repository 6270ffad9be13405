"""Every registered query against its SQL, or that it runs where SQL cannot express it."""

import pytest

from phasemesh.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(name, spark, tiny):
    rows = catalog.QUERIES[name](spark, tiny).collect()
    assert rows
    assert all(v is None or v == v for r in rows for v in r)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["subj", "t", "fd"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
