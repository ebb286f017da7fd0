import pytest

from edgeloom.plans.catalogue import QUERIES, SQL
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    same(spark, QUERIES[name], SQL[name], sf)


SEARCHES = [n for n in sorted(SQL) if n.startswith(("khop", "path", "components", "pagerank", "overlay_", "registered_khop"))]


@pytest.mark.parametrize("name", SEARCHES)
def test_distributed_plan_matches_sql(spark, sf, name):
    from edgeloom.operators.small import CONF

    spark.conf.set(CONF, "0")
    try:
        same(spark, QUERIES[name], SQL[name], sf)
    finally:
        spark.conf.unset(CONF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
