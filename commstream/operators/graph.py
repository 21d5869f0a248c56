"""Graph tables: edges(src, dst, w) with each undirected edge once and whole-number weights; adj(v, u, w) both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commstream.config import InvalidInput


def weighted(edges: DataFrame, scale: int = 1) -> DataFrame:
    """Edges with a missing weight read as 1 and all weights times scale, rounded to whole numbers."""
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    return edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.round(weight * scale).cast("long").alias("w"))


def compress(edges: DataFrame) -> DataFrame:
    """One row (src <= dst) for each pair with its summed weight; pairs that sum to zero go."""
    pair = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
    return pair.groupBy("src", "dst").agg(F.sum("w").alias("w")).where("w <> 0")


def half_arcs(arcs: DataFrame) -> DataFrame:
    """Arcs with src <= dst, self-loops included; for sources that list both directions."""
    return arcs.where("src <= dst")


def symmetric(edges: DataFrame) -> DataFrame:
    """adj(v, u, w): each edge in both directions; a self-loop stands twice in its row."""
    return edges.select(F.col("src").alias("v"), F.col("dst").alias("u"), "w").unionByName(edges.select(F.col("dst").alias("v"), F.col("src").alias("u"), "w"))


def neighbours(edges: DataFrame) -> DataFrame:
    """adj without self-loops."""
    return symmetric(edges.where("src <> dst"))


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(v, d): summed weights, a self-loop twice; with vertices, isolated ones have 0."""
    found = symmetric(edges).groupBy("v").agg(F.sum("w").alias("d"))
    return found if vertices is None else vertices.select("v").join(found, "v", "left").select("v", F.coalesce("d", F.lit(0)).alias("d"))


def row_lengths(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, n): entries in each adjacency row."""
    found = symmetric(edges).groupBy("v").agg(F.count("*").alias("n"))
    return vertices.select("v").join(found, "v", "left").select("v", F.coalesce("n", F.lit(0)).alias("n"))


def total_weight(edges: DataFrame) -> DataFrame:
    """One row: m2, twice the total weight."""
    return edges.agg(F.coalesce(F.sum("w") * 2, F.lit(0)).alias("m2"))


def twice_total(edges: DataFrame) -> int:
    return int(total_weight(edges).first()["m2"])


def community_degrees(degree: DataFrame, mapping: DataFrame) -> DataFrame:
    """(c, dc): summed degrees of each community."""
    return mapping.join(degree, "v").groupBy("c").agg(F.sum("d").alias("dc"))


def apply_delta(edges: DataFrame, delta: DataFrame) -> DataFrame:
    """The graph after weight changes delta(src, dst, w); weights that fall to zero go."""
    return compress(edges.select("src", "dst", "w").unionByName(delta.select("src", "dst", "w")))


def check_weights(edges: DataFrame) -> DataFrame:
    """edges, or InvalidInput where a weight is negative."""
    bad = edges.where("w < 0").first()
    if bad:
        raise InvalidInput(f"the weight of ({bad['src']}, {bad['dst']}) is {bad['w']}")
    return edges


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Weight changes that turn one graph into the other."""
    return compress(after.select("src", "dst", "w").unionByName(before.select("src", "dst", (-F.col("w")).alias("w"))))


def unknown_endpoints(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Distinct edge ends that are no vertex."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
    return ends.join(vertices.select("v"), "v", "left_anti")


def check_endpoints(edges: DataFrame, vertices: DataFrame) -> None:
    bad = unknown_endpoints(edges, vertices).first()
    if bad:
        raise InvalidInput(f"edge end {bad['v']} is no vertex")


def checksum(edges: DataFrame) -> DataFrame:
    """One row that any order of the edges gives alike: count, sums, and a sum of products modulo a prime."""
    mixed = (F.col("src") * 1000003 + F.col("dst") * 10007 + F.col("w") * 101) % 2147483647
    return edges.agg(F.count("*").alias("n_edges"), F.coalesce(F.sum("w"), F.lit(0)).alias("sum_w"), F.coalesce(F.sum(mixed), F.lit(0)).alias("mixed"))
