"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on, so there are at most so many hot keys.
HOT_KEYS = 10_000
LEAST_HOT_ROWS = 200


def hot_rows(total: int) -> int:
    """From how many rows on a key is hot, of total rows: at most HOT_KEYS keys are."""
    return max(LEAST_HOT_ROWS, -(-total // HOT_KEYS))


def join_by_key(rows: DataFrame, table: DataFrame, on: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with table, which has one row for each key (keys not null); rows of hot keys are not shuffled.

    hot: rows of table with a hot key, HOT_KEYS at most; they are broadcast. how: inner or left. Both inputs are read
    twice, so they should be tables.
    """
    few = F.broadcast(hot.select(*table.columns).withColumn("_hot", F.lit(True)))
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(table, on, how)
    return rows.join(few, on).drop("_hot").select(*rest.columns).unionByName(rest)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of shuffles that nothing reads any more: Spark deletes their files when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
