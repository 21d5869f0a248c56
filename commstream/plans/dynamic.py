"""Changing graphs for replay: seeded split into an initial graph and batches, cumulative and sliding windows."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commstream.config import RunConfig
from commstream.plans.engine import maintain, run
from commstream.storage import materialize


def shuffled(edges: DataFrame, seed: int = 42) -> DataFrame:
    """edges with position: 0, 1, ... in an order that only seed and edge decide (an MD5), the same in any engine.

    The order is built from 256 ranges of the digest and their counts, so no task holds all edges.
    """
    keyed = edges.withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), "src", "dst"))).withColumn("range", F.substring("key", 1, 2))
    starts = keyed.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("range")) - F.col("n"))
    within = F.row_number().over(Window.partitionBy("range").orderBy("key", "src", "dst")) - 1
    return keyed.withColumn("at", within).join(starts, "range").withColumn("position", (F.col("before") + F.col("at")).cast("long")).drop("key", "range", "n", "before", "at")


def split(edges: DataFrame, ratio: float = 0.8, batch_size: int = 1000, rounds: int = 9, seed: int = 42) -> DataFrame:
    """edges with batch_id: -1 for the initial share, then full batches 0, 1, ...; what is left over goes.

    At most rounds batches, fewer where the edges do not fill them.
    """
    placed = shuffled(edges, seed)
    total = edges.count()
    first = int(total * min(max(ratio, 0.0), 1.0))
    effective = min(rounds, (total - first) // batch_size) if batch_size > 0 else 0
    batch = F.when(F.col("position") < first, F.lit(-1)).otherwise(F.floor((F.col("position") - first) / F.lit(max(1, batch_size))))
    return placed.withColumn("batch_id", batch.cast("long")).where(F.col("batch_id") < effective)


def batch_totals(batches: DataFrame) -> DataFrame:
    """(batch_id, n_edges, total_edges): edges of each batch and up to it."""
    sizes = batches.groupBy("batch_id").agg(F.count("*").alias("n_edges"))
    return sizes.withColumn("total_edges", F.sum("n_edges").over(Window.orderBy("batch_id")))


def edges_added(totals: DataFrame) -> DataFrame:
    """(batch_id, total_edges, edges_added): the step from the batch before, 0 at least."""
    before = F.lag("total_edges", 1, 0).over(Window.orderBy("batch_id"))
    return totals.select("batch_id", "total_edges", F.greatest(F.col("total_edges") - before, F.lit(0)).alias("edges_added"))


def cumulative(batches: DataFrame, upto: int) -> DataFrame:
    return batches.where(F.col("batch_id") <= upto)


def sliding_delta(batches: DataFrame, width: int) -> DataFrame:
    """(batch_id, src, dst, w): each batch's own edges, and those that leave a window of so many batches, negative."""
    last = batches.agg(F.max("batch_id")).first()[0]
    leave = batches.select((F.col("batch_id") + width).alias("batch_id"), "src", "dst", (-F.col("w")).alias("w")).where(F.col("batch_id") <= F.lit(last))
    return batches.select("batch_id", "src", "dst", "w").unionByName(leave).groupBy("batch_id", "src", "dst").agg(F.sum("w").alias("w")).where("w <> 0")


METRICS = "batch_idx long, edges_added long, total_edges long, nodes_in_graph long, incremental_ms double, scratch_ms double, speedup double, iterations long, modularity double"


def replay(batches: DataFrame, vertices: DataFrame, config: RunConfig | None = None, scratch: bool = True, together: int = 1) -> DataFrame:
    """A row of METRICS for each batch: maintained from the batch's edges alone, against a run on all edges so far.

    Both times cover building the graph and the quality of the result. The batches come first, one by one; then up to
    together runs from scratch go on at once, fewer where their graphs have more than twice config.local_edges edges.
    With more than one the replay ends sooner, but their times hold the waiting for one another.
    """
    spark, config, rows = batches.sparkSession, config or RunConfig(), []
    batches, vertices = materialize(batches.select("batch_id", "src", "dst", "w")), materialize(vertices.select("v").distinct())
    state = run(cumulative(batches, -1), vertices, config).state
    n_vertices, total = vertices.count(), cumulative(batches, -1).count()
    for (b,) in sorted(batches.where("batch_id >= 0").select("batch_id").distinct().collect()):
        own = batches.where(F.col("batch_id") == b)
        added = own.count()
        total += added
        done = maintain(state, own.select("src", "dst", "w"), int(b), config)
        state = done.state
        rows.append((int(b), added, total, n_vertices, done.seconds, done.rounds, done.quality))

    def seconds(row):
        began = time.time()
        run(cumulative(batches, row[0]), vertices, config)
        return time.time() - began

    with ThreadPoolExecutor(max(1, min(together, 2 * config.local_edges // max(total, 1)))) as pool:
        others = list(pool.map(seconds, rows)) if scratch else [0.0] * len(rows)
    metrics = [(*r[:4], r[4] * 1000, other * 1000, other / r[4] if r[4] > 0 else 0.0, *r[5:]) for r, other in zip(rows, others, strict=True)]
    return spark.createDataFrame(metrics, METRICS)


def summary(metrics: DataFrame) -> DataFrame:
    """One row: totals, mean of the speedups, ratio of the totals, and the median speedup; 0 where nothing is there."""
    a, b = F.coalesce(F.sum("incremental_ms"), F.lit(0.0)), F.coalesce(F.sum("scratch_ms"), F.lit(0.0))
    return metrics.agg(a.alias("incremental_ms"), b.alias("scratch_ms"), F.coalesce(F.avg("speedup"), F.lit(0.0)).alias("mean_speedup"), F.when(a > 0, b / a).otherwise(0.0).alias("total_speedup"), F.coalesce(F.expr("percentile(speedup, 0.5)"), F.lit(0.0)).alias("median_speedup"))
