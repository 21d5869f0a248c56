"""Checks of partitions and states, each a DataFrame of violations or one row of verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commstream.config import Mode
from commstream.operators.aggregate import supergraph
from commstream.operators.components import connected_components
from commstream.operators.graph import difference
from commstream.operators.refine import inside_edges
from commstream.plans.quality import modularity


def partition_invariants(vertices: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: numbers of vertices, mapped rows and mapped vertices, of communities that are no vertex, and ok."""
    n = vertices.agg(F.count("*").alias("n_vertices"))
    m = mapping.agg(F.count("*").alias("n_rows"), F.count_distinct("v").alias("n_mapped"))
    stray = mapping.select(F.col("c").alias("v")).distinct().join(vertices, "v", "left_anti").agg(F.count("*").alias("n_stray"))
    ok = (F.col("n_vertices") == F.col("n_rows")) & (F.col("n_rows") == F.col("n_mapped")) & (F.col("n_stray") == 0)
    return n.crossJoin(m).crossJoin(stray).withColumn("ok", ok.cast("int"))


def nesting_violations(subs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sub-communities that reach into several communities."""
    return subs.join(mapping, "v").groupBy("s").agg(F.count_distinct("c").alias("n")).where("n > 1")


def disconnected_subs(edges: DataFrame, subs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sub-communities of more than one connected piece."""
    found = connected_components(inside_edges(edges, subs, mapping), "src", "dst")
    own = subs.join(found, "v", "left").select("s", F.coalesce("component", "v").alias("piece"))
    return own.groupBy("s").agg(F.count_distinct("piece").alias("pieces")).where("pieces > 1")


def conservation_violations(edges: DataFrame, subs: DataFrame, above: DataFrame) -> DataFrame:
    """Superedges whose weight differs from what the level below sums to."""
    return difference(supergraph(edges, subs), above)


def identity_violations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Vertices that two partitions place differently."""
    return a.select("v", F.col("c").alias("x")).join(b.select("v", F.col("c").alias("y")), "v", "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))


def equivalence(edges: DataFrame, vertices: DataFrame, a: DataFrame, b: DataFrame, mode: Mode, tolerance: float = 0.001) -> DataFrame:
    """One row: deterministic runs must be identical; throughput runs may differ in quality by the tolerance."""
    differ = identity_violations(a, b).agg(F.count("*").alias("n_differ"))
    qa, qb = (modularity(edges, x).select(F.col("q").alias(n)) for x, n in ((a, "q_reference"), (b, "q_candidate")))
    row = differ.crossJoin(qa).crossJoin(qb).withColumn("delta_q", F.col("q_candidate") - F.col("q_reference"))
    ok = F.col("n_differ") == 0 if mode is Mode.DETERMINISTIC else F.abs("delta_q") <= tolerance
    return row.crossJoin(partition_invariants(vertices, b).select(F.col("ok").alias("invariants_ok"))).withColumn("equivalent", ok.cast("int"))
