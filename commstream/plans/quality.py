"""Quality of a partition: modularity, constant Potts, and the gap to what moves could still gain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commstream.operators.graph import community_degrees, degrees, twice_total
from commstream.operators.movement import best_moves, candidates


def community_table(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """(c, inside, dc): twice the weight inside each community, and its degree."""
    at = lambda end: mapping.select(F.col("v").alias(end), F.col("c").alias(f"c_{end}"))
    inside = edges.join(at("src"), "src").join(at("dst"), "dst").where("c_src = c_dst").groupBy(F.col("c_src").alias("c")).agg((F.sum("w") * 2).alias("inside"))
    return community_degrees(degrees(edges), mapping).join(inside, "c", "left").select("c", F.coalesce("inside", F.lit(0)).alias("inside"), "dc")


def modularity(edges: DataFrame, mapping: DataFrame, num: int = 1, den: int = 1) -> DataFrame:
    """One row: q (0 for a graph without weight) and n_communities, counted over all of mapping."""
    table = community_table(edges, mapping)
    sums = table.agg(F.sum("inside").alias("inside"), F.sum(F.col("dc").cast("decimal(38,0)") * F.col("dc")).cast("double").alias("squares"), F.sum("dc").alias("m2"))
    q = F.when(F.col("m2") > 0, F.col("inside") / F.col("m2") - F.lit(num / den) * F.col("squares") / (F.col("m2").cast("double") * F.col("m2"))).otherwise(F.lit(0.0))
    return sums.crossJoin(mapping.agg(F.count_distinct("c").alias("n_communities"))).select(F.coalesce(q, F.lit(0.0)).alias("q"), "n_communities")


def constant_potts(edges: DataFrame, mapping: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: cpm = sum over communities of inner weight - resolution * n (n - 1) / 2."""
    inside = community_table(edges, mapping).select("c", (F.col("inside") / 2).alias("inside"))
    sizes = mapping.groupBy("c").agg(F.count("*").alias("n"))
    cost = F.coalesce("inside", F.lit(0.0)) - F.lit(resolution) * F.col("n") * (F.col("n") - 1) / 2
    return sizes.join(inside, "c", "left").agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("cpm"))


def open_moves(edges: DataFrame, adj: DataFrame, mapping: DataFrame) -> DataFrame:
    """Vertices with a move of positive gain left; none means that the partition is vertex-optimal."""
    return best_moves(candidates(adj, mapping, degrees(edges), twice_total(edges)))


def dense_share(edges: DataFrame, mapping: DataFrame, num: int = 1, den: int = 1) -> DataFrame:
    """One row: share of communities whose weight between any vertex and the rest is at least its expected weight.

    This is the first condition of the greedy density order: no vertex would gain by leaving for itself.
    """
    degree, m2 = degrees(edges), twice_total(edges)
    at = lambda end: mapping.select(F.col("v").alias(end), F.col("c").alias(f"c_{end}"))
    inner = edges.where("src <> dst").join(at("src"), "src").join(at("dst"), "dst").where("c_src = c_dst")
    tie = inner.select(F.explode(F.array("src", "dst")).alias("v"), "w").groupBy("v").agg(F.sum("w").alias("tie"))
    own = mapping.join(degree, "v").join(community_degrees(degree, mapping), "c").join(tie, "v", "left")
    loose = F.lit(den * m2) * F.coalesce("tie", F.lit(0)) < F.lit(num) * F.col("d") * (F.col("dc") - F.col("d"))
    return own.groupBy("c").agg(F.max(loose.cast("int")).alias("loose")).agg(F.avg(1 - F.col("loose")).alias("dense_share"))
