"""Writing results: partitions, metrics as CSV and JSON, and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    """Batch metrics with a header and six decimals."""
    shown = [F.format_string("%.6f", c).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes]
    metrics.select(*shown).coalesce(1).write.mode("overwrite").csv(path, header=True)


def metrics_json(metrics: DataFrame, dataset: str, setup: dict[str, str]) -> DataFrame:
    """One row, one column: the dataset, its setup, a summary and all batches as JSON."""
    order = "batch_idx"
    batch = F.sort_array(F.collect_list(F.struct(order, *[c for c in metrics.columns if c != order]))).alias("batches")
    told = F.create_map(*[F.lit(x) for kv in setup.items() for x in kv]) if setup else F.create_map()
    head = metrics.agg(F.count("*").alias("n_batches"), F.sum("edges_added").alias("edges_added"), batch)
    return head.select(F.to_json(F.struct(F.lit(dataset).alias("dataset"), told.alias("setup"), F.struct("n_batches", "edges_added").alias("summary"), "batches")).alias("value"))


def write_artifact(outcome, path: str) -> None:
    """A text file that names the run, its quality and its communities."""
    spark = outcome.state.levels[0].edges.sparkSession
    text = f"run={outcome.run_id} quality={outcome.quality:.6f} communities={outcome.n_communities} rounds={outcome.rounds}"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_partition(partition: DataFrame, path: str) -> None:
    partition.write.mode("overwrite").parquet(path)
