import pytest

import __spark_entry__
from compare import assert_same, duck
from quernel.plans.oracles import SQL
from quernel.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_what_sql_says(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).columns == ["customer_id", "recency", "frequency", "monetary"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
