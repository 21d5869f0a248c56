import os

import pytest
from pyspark.sql import functions as F

from commstream import storage


def test_tables_are_read_back_and_can_be_dropped(spark):
    before = spark.conf.get(storage._CLEANUP, None)
    table = storage.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    assert table.agg(F.sum("n")).first()[0] == 1000
    assert spark.conf.get(storage._CLEANUP, None) == before
    path = table.materialized_at.removeprefix("file://")
    assert os.path.isdir(path)
    storage.drop_tables(table)
    assert not os.path.exists(path)
    with pytest.raises(ValueError):
        storage.drop_tables(table)
