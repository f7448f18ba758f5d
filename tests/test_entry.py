import __spark_entry__ as entry


def test_each_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["job", "conv_id", "turn", "role", "out_pos", "collated"] and df.count() > 0
