"""Every registered query against its check SQL on the smallest tables."""

import pytest

from vigil.plans import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    from compare import connect

    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_query_matches_sql(name, spark, sf_dir, con):
    from compare import difference

    found = difference(QUERIES[name].run(spark, sf_dir), con, QUERIES[name].sql)
    assert found is None, found


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
