import pytest
from twins import DATA, connection, same

from corpuslake import plans


@pytest.fixture(scope="module")
def duck():
    return connection()


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    same(plans.QUERIES[name](spark, DATA).toPandas(), duck.sql(plans.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_without_sql_runs_and_repeats(spark, name):
    first = sorted(map(str, plans.QUERIES[name](spark, DATA).collect()))
    assert first
    assert first == sorted(map(str, plans.QUERIES[name](spark, DATA).collect()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
