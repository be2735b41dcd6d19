"""The text operators' queries that SQL can express."""

import pytest

from lodestone.llm import queries

from ..oracle import same_rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    same_rows(spark, queries.queries()[name], queries.oracle_sql()[name])
