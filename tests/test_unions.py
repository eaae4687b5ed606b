"""Queries whose tables are too large to broadcast, so that all joins are shuffled ones."""

import pytest
from twins import DATA, connection, same

from corpuslake import plans


@pytest.fixture
def no_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["t8_build_graph", "q2_validate_graph", "a23_decision_forms"])
def test_query_equals_its_sql_without_broadcasts(no_broadcasts, name):
    same(plans.QUERIES[name](no_broadcasts, DATA).toPandas(), connection().sql(plans.ORACLE_SQL[name]).df())
