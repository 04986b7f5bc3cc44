"""Registered queries against the SQL that states their results."""

import pytest

from vigil.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, sf_dir):
    from compare import connect, difference

    found = difference(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name])
    assert found is None, found


def test_every_operator_and_the_pipeline_are_registered():
    import __spark_entry__ as entry
    import corpus_pipeline

    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5 and set(SQL) <= set(entry.oracle_sql())
