import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert sum(name.startswith("q_") for name in entry.queries()) >= 50


def test_entry(spark):
    assert entry.entry(spark).columns == ["v", "cur", "cand", "gain"]
