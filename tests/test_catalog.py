"""Every registered query with SQL gives the SQL's rows at the smallest scale; the others run."""

import pytest

import catalog
from catalog.compare import matches


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    catalog.ship(spark)


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    assert matches(got, duck.sql(catalog.SQL[name]).df()) is None


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.SQL])
def test_query_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
