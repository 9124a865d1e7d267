import __spark_entry__


def test_registry():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["func_call_id", "step"] and rows.count() > 0
