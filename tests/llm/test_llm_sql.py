"""The training-data queries that SQL can express equal their SQL on whole tables."""

import pytest
from oracle import compare

from sluice.llm import oracles, queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, queries.QUERIES[name], oracles.ORACLES[name], SMALL)
