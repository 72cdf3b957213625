import pytest
from oracle import compare

from sluice import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - {n for n in catalogue.QUERIES if n.startswith("train_eval")}))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0
