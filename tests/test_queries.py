"""Every registered query with SQL gives the rows that DuckDB gives."""

import pytest

from lodestone import queries

from .oracle import SF, same_rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    same_rows(spark, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.SQL.keys() - {"eval_loop"}))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
    assert queries.QUERIES.keys() <= __spark_entry__.queries().keys() and __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
