"""Every registered query of the engine against its SQL."""

import pytest

from lorekeep.plans import retrieval_queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(retrieval_queries.QUERIES))
def test_query_has_the_rows_of_its_sql(spark, name):
    compare(spark, retrieval_queries.QUERIES[name], retrieval_queries.ORACLES[name])
