"""Edge changes as a stream: each micro-batch maintains the state and appends a feed of changed communities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commstream.config import RunConfig
from commstream.plans.engine import State, changes, maintain

DELTA = "event_id long, ts timestamp, src long, dst long, w long"


def read_deltas(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(DELTA).parquet(path)


def once(deltas: DataFrame, late: str = "1 hour") -> DataFrame:
    """Deltas without redelivered events, as far back as the watermark."""
    return deltas.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(deltas: DataFrame, width: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Weight by event-time window; with slide, windows overlap."""
    return deltas.withWatermark("ts", late).groupBy(F.window("ts", width, slide)).agg(F.sum("w").alias("w"), F.count("*").alias("n"))


class Maintainer:
    """Holds the newest state; each micro-batch is applied once, whatever is redelivered after a restart of the query."""

    def __init__(self, state: State, feed: Callable[[DataFrame], None] | None = None, config: RunConfig | None = None):
        self.state, self.feed, self.config = state, feed, config

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.state.batch_id or batch.isEmpty():
            return
        before = self.state.communities()
        self.state = maintain(self.state, batch.select("src", "dst", "w"), batch_id, self.config).state
        if self.feed:
            self.feed(changes(before, self.state.communities(), batch_id))

    def start(self, deltas: DataFrame, checkpoint: str):
        return deltas.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
