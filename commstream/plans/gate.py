"""Release gate and baseline comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNPINNED = "UNPINNED_HARDWARE_PROFILE"
LIVE = "LIVE_QUERY_SOURCE_INELIGIBLE_FOR_RELEASE_GATE"


def eligible(runs: DataFrame) -> DataFrame:
    """runs(profile_id, pinned, source) with eligible and reason; an unpinned profile is named before a live source."""
    reason = F.when(~F.coalesce("pinned", F.lit(False)), F.lit(UNPINNED)).when(F.col("source") == "live", F.lit(LIVE))
    return runs.select("profile_id", "pinned", "source", reason.isNull().cast("int").alias("eligible"), reason.alias("reason"))


def compare_baseline(base: DataFrame, candidate: DataFrame, profile_id: str, pinned: bool, source: str = "file", least_gain: float = 2.0) -> DataFrame:
    """One row: median gain of measured seconds by batch, whether it reaches the target, and the gate's verdict."""
    both = base.select("batch_idx", F.col("seconds").alias("a")).join(candidate.select("batch_idx", F.col("seconds").alias("b")), "batch_idx")
    gain = both.where("b > 0").agg(F.expr("percentile(a / b, 0.5)").alias("median_gain"), F.count("*").alias("n_batches"))
    run = base.sparkSession.createDataFrame([(profile_id, pinned, source)], "profile_id string, pinned boolean, source string")
    return gain.withColumn("reaches", (F.coalesce("median_gain", F.lit(0.0)) >= least_gain).cast("int")).crossJoin(eligible(run))
