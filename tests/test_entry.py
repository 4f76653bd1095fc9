import __spark_entry__ as entry


def test_contract(spark):
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names)
    df = entry.entry(spark)
    assert df.columns == ["file_path", "term", "score"]
