import pytest

from pointloom.plans import queries
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    oracle.same(queries.QUERIES[name](spark, oracle.DATA), queries.SQL[name])


def test_fingerprint_is_free_of_order(spark):
    from pointloom.operators.statistics import fingerprint

    a = spark.range(1000).selectExpr("id", "id * 2 AS x")
    assert fingerprint(a, "id", "x").first() == fingerprint(a.repartition(7).orderBy("x", ascending=False), "id", "x").first()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
