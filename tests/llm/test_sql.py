import pytest

from invarium.llm.queries import QUERIES, SQL
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", SQL)
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF), SF, QUERIES[name], SQL[name]) > 0
