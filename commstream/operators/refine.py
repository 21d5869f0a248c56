"""Refinement: sub-communities stay connected inside their community, and lone vertices merge into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commstream.config import NotSettled
from commstream.functions.gain import gain_numerator
from commstream.operators.components import connected_components
from commstream.operators.graph import community_degrees
from commstream.operators.movement import accept_roles, accept_sure, applied, best_moves, quality_numerator
from commstream.storage import materialize


def inside_edges(edges: DataFrame, subs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges whose ends share sub-community and community."""
    own = subs.join(mapping, "v")
    at = lambda end: own.select(F.col("v").alias(end), F.col("s").alias(f"s_{end}"), F.col("c").alias(f"c_{end}"))
    return edges.join(at("src"), "src").join(at("dst"), "dst").where("s_src = s_dst and c_src = c_dst").select("src", "dst", "w")


def pieces(edges: DataFrame, subs: DataFrame, mapping: DataFrame, of: DataFrame) -> DataFrame:
    """(v, s, piece): connected pieces of the sub-communities that hold a vertex of ``of``; piece is a smallest vertex."""
    touched = of.join(subs, "v").select("s").distinct()
    own = subs.join(touched, "s", "left_semi").select("v", "s")
    held = inside_edges(edges, own, mapping)
    found = connected_components(held, "src", "dst").withColumnRenamed("component", "piece")
    return own.join(found, "v", "left").select("v", "s", F.coalesce("piece", "v").alias("piece"))


def largest_pieces(found: DataFrame) -> DataFrame:
    """(s, piece): of each sub-community the piece with most vertices, ties to the smallest; it keeps the id."""
    sizes = found.groupBy("s", "piece").agg(F.count("*").alias("n"))
    return sizes.groupBy("s").agg(F.min(F.struct((-F.col("n")).alias("loss"), "piece")).alias("first")).select("s", F.col("first.piece").alias("piece"))


def new_ids(found: DataFrame, ceiling: int) -> DataFrame:
    """(piece, id) for all pieces but the largest ones: numbers after ceiling in order of the smallest member."""
    rest = found.select("s", "piece").distinct().join(largest_pieces(found), ["s", "piece"], "left_anti").select("piece")
    parts = rest.repartitionByRange("piece").withColumn("part", F.spark_partition_id())
    parts = materialize(parts.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("piece"))))
    # The window without a partition holds a row for each partition of the range, not for each piece.
    starts = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    return parts.join(starts, "part").select("piece", (F.lit(ceiling) + F.col("before") + F.col("at")).cast("long").alias("id"))


def split(edges: DataFrame, subs: DataFrame, mapping: DataFrame, of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sub-communities after splitting disconnected ones, and the vertices that got a new id."""
    found = materialize(pieces(edges, subs, mapping, of))
    ceiling = int(subs.agg(F.greatest(F.max("s"), F.max("v"))).first()[0] or 0)
    ids = found.join(new_ids(found, ceiling), "piece").select("v", F.col("id").alias("new"))
    ids = materialize(ids)
    return materialize(subs.join(ids, "v", "left").select("v", F.coalesce("new", "s").alias("s"))), ids.select("v")


def singletons(subs: DataFrame) -> DataFrame:
    return subs.groupBy("s").agg(F.count("*").alias("n"), F.min("v").alias("v")).where("n = 1").select("v", "s")


def merge_moves(adj: DataFrame, subs: DataFrame, mapping: DataFrame, degree: DataFrame, m2: int, num: int = 1, den: int = 1, of: DataFrame | None = None) -> DataFrame:
    """(v, cur, cand, gain) of lone vertices into well tied sub-communities of their community.

    A sub-community is well tied where leaving for itself would not pay: its weight to the rest of its community,
    den * M * w(S, C - S), is at least num * d(S) * (d(C) - d(S)).
    """
    own = subs.join(mapping, "v").join(degree, "v")
    inner = adj.join(own.select("v", "s", "c"), "v").join(own.select(F.col("v").alias("u"), F.col("s").alias("su"), F.col("c").alias("cu")), "u").where("c = cu and s <> su")
    whole = own.groupBy("c").agg(F.sum("d").alias("dc"))
    parts = own.groupBy("s", "c").agg(F.sum("d").alias("ds")).join(whole, "c")
    cut = inner.groupBy("s").agg(F.sum("w").alias("cut"))
    tied = parts.join(cut, "s", "left").where(F.lit(den * m2) * F.coalesce("cut", F.lit(0)) >= F.lit(num) * F.col("ds") * (F.col("dc") - F.col("ds")))
    alone = singletons(subs).select("v")
    if of is not None:
        alone = alone.join(of, "v", "left_semi")
    near = inner.join(alone, "v", "left_semi").groupBy("v", "s", "su").agg(F.sum("w").alias("w"))
    moves = near.join(degree, "v").join(tied.select(F.col("s").alias("su"), "ds"), "su")
    gain = gain_numerator(m2, "w", F.lit(0), "d", F.col("d"), "ds", num, den)
    return moves.select("v", F.col("s").alias("cur"), F.col("su").alias("cand"), gain.alias("gain"))


def merge(adj: DataFrame, subs: DataFrame, mapping: DataFrame, degree: DataFrame, m2: int, num: int = 1, den: int = 1, of: DataFrame | None = None, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rounds of merging lone vertices until none is left to merge; the result and the vertices that merged.

    Many may enter one sub-community in a round; where that does not raise the exact quality, the round is done over
    with those that are sure to. NotSettled where moves are left after rounds.
    """
    merged, n = subs.select("v").limit(0), 0
    edges = adj.where("v < u").select(F.col("v").alias("src"), F.col("u").alias("dst"), "w")
    as_mapping = lambda x: x.select("v", F.col("s").alias("c"))
    now = quality_numerator(edges, degree, as_mapping(subs), m2, num, den)
    while True:
        best = materialize(best_moves(merge_moves(adj, subs, mapping, degree, m2, num, den, of)))
        if best.isEmpty():
            break
        if rounds is not None and n >= rounds:
            raise NotSettled(f"lone vertices are left to merge after {rounds} rounds")
        n += 1
        chosen = materialize(accept_roles(best))
        after = materialize(applied(as_mapping(subs), chosen))
        then = quality_numerator(edges, degree, after, m2, num, den)
        if then <= now:
            chosen = materialize(accept_sure(chosen, degree, num))
            after = materialize(applied(as_mapping(subs), chosen))
            then = quality_numerator(edges, degree, after, m2, num, den)
        subs, now = after.select("v", F.col("c").alias("s")), then
        merged = merged.unionByName(chosen.select("v"))
    return subs, merged


def sub_degrees(degree: DataFrame, subs: DataFrame) -> DataFrame:
    return community_degrees(degree, subs.select("v", F.col("s").alias("c"))).select(F.col("c").alias("s"), F.col("dc").alias("ds"))


def degree_order(degree: DataFrame) -> DataFrame:
    """(v, d, position): by degree, then id; ranks within a degree follow counts of smaller degrees, so no single sort."""
    counts = degree.groupBy("d").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("d")) - F.col("n"))
    within = F.row_number().over(Window.partitionBy("d").orderBy("v"))
    return degree.withColumn("at", within).join(before, "d").select("v", "d", (F.col("before") + F.col("at")).cast("long").alias("position"))
