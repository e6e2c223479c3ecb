"""Every registered query of the engine against its SQL, or that it runs."""

import pytest
from compare import same

from fieldlake.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, sf, name):
    same(registry.QUERIES[name](spark, sf), registry.SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_sql_belongs_to_queries():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_random_clouds_stand_around_every_order(spark, sf):
    from fieldlake.plans.motion import QUERIES

    orders = {r[0] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect()}
    assert {r[0] for r in QUERIES["g6_random_cloud"](spark, sf).select("centre").collect()} == orders
