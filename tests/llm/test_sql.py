"""The corpus queries that SQL can express, against DuckDB."""

import pytest
from tests.oracle import connect, same
from topograin.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf, name):
    same(queries.queries()[name](spark, sf), connect(sf), queries.oracle_sql()[name])
