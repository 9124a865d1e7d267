import pytest

from invarium.queries import QUERIES, SQL
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"
ROWS_ONLY = [q for q in QUERIES if q not in SQL]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SQL)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], SQL[name]) > 0


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0
