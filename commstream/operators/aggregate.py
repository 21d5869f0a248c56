"""Supergraphs: sub-communities as vertices, summed weights as edges, and their change under a change below."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commstream.operators.graph import compress


def supergraph(edges: DataFrame, subs: DataFrame) -> DataFrame:
    at = lambda end: subs.select(F.col("v").alias(end), F.col("s").alias(f"s_{end}"))
    lifted = edges.join(at("src"), "src").join(at("dst"), "dst")
    return compress(lifted.select(F.col("s_src").alias("src"), F.col("s_dst").alias("dst"), "w"))


def delta_superedges(after: DataFrame, delta: DataFrame, before_subs: DataFrame, after_subs: DataFrame) -> DataFrame:
    """What the supergraph changes by: the delta under the old sub-communities, and edges of vertices that changed theirs.

    after is the graph with the delta applied. Each edge with a changed end is taken from its old superedge and
    added to its new one; an edge with two changed ends stands once in the table of edges, so it counts once.
    """
    both = before_subs.select("v", F.col("s").alias("old")).join(after_subs.select("v", F.col("s").alias("new")), "v")
    at = lambda end: both.select(F.col("v").alias(end), F.col("old").alias(f"old_{end}"), F.col("new").alias(f"new_{end}"))
    changed = delta.join(at("src"), "src").join(at("dst"), "dst").select(F.col("old_src").alias("src"), F.col("old_dst").alias("dst"), "w")
    lifted = after.join(at("src"), "src").join(at("dst"), "dst").where("old_src <> new_src or old_dst <> new_dst")
    out = lifted.select(F.col("old_src").alias("src"), F.col("old_dst").alias("dst"), (-F.col("w")).alias("w"))
    into = lifted.select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "w")
    return compress(changed.unionByName(out).unionByName(into))


def relabelled(mapping: DataFrame, subs: DataFrame) -> DataFrame:
    """(v, c) of supervertices: the community of their members, named by its smallest supervertex."""
    lifted = subs.join(mapping, "v").select(F.col("s").alias("v"), "c").distinct()
    names = lifted.groupBy("c").agg(F.min("v").alias("name"))
    return lifted.join(names, "c").select("v", F.col("name").alias("c"))
