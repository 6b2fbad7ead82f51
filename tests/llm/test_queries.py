"""Queries of the subpackage against their SQL."""

import pytest

from lorekeep.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_has_the_rows_of_its_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name])
