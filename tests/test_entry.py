import __spark_entry__ as entry


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "territory_name"


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(q) for q in entry.queries().values())
