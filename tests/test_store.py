"""Tables kept in the shared folder."""

from reckon import store


def test_keep_and_clean(spark):
    df = store.keep(spark.range(5), "t")
    assert df.count() == 5 and df.inputFiles()[0].startswith("file:")
    assert store.clean(spark) >= 1 and store.clean(spark) == 0


def test_entry_and_names():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
