"""Local movement: which vertices to look at, what each would do, and which moves go together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commstream.config import Mode, NotSettled
from commstream.functions.gain import gain_numerator
from commstream.operators.graph import community_degrees
from commstream.storage import materialize


def activated(delta: DataFrame, mapping: DataFrame) -> DataFrame:
    """Vertices that a weight change may move: ends of gains across communities and of losses inside one."""
    at = lambda end: mapping.select(F.col("v").alias(end), F.col("c").alias(f"c_{end}"))
    both = delta.join(at("src"), "src").join(at("dst"), "dst")
    hit = both.where("(w > 0 and c_src <> c_dst) or (w < 0 and c_src = c_dst)")
    return hit.select(F.explode(F.array("src", "dst")).alias("v")).distinct()


def affected(delta: DataFrame, subs: DataFrame) -> DataFrame:
    """Vertices whose sub-community a change inside it may split."""
    at = lambda end: subs.select(F.col("v").alias(end), F.col("s").alias(f"s_{end}"))
    both = delta.where("w < 0").join(at("src"), "src").join(at("dst"), "dst").where("s_src = s_dst")
    return both.select(F.explode(F.array("src", "dst")).alias("v")).distinct()


def neighbour_weights(adj: DataFrame, mapping: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """(v, cand, w): weight from each vertex to each community next to it."""
    rows = adj if active is None else adj.join(active, "v", "left_semi")
    return rows.join(mapping.select(F.col("v").alias("u"), F.col("c").alias("cand")), "u").groupBy("v", "cand").agg(F.sum("w").alias("w"))


def candidates(adj: DataFrame, mapping: DataFrame, degree: DataFrame, m2: int, num: int = 1, den: int = 1, active: DataFrame | None = None) -> DataFrame:
    """(v, cur, cand, gain) of every move to another community next to a vertex."""
    near = neighbour_weights(adj, mapping, active)
    held = community_degrees(degree, mapping)
    own = mapping.join(degree, "v").join(held, "c").select("v", F.col("c").alias("cur"), "d", F.col("dc").alias("d_cur"))
    inside = near.join(own.select("v", F.col("cur").alias("cand")), ["v", "cand"]).select("v", F.col("w").alias("w_cur"))
    moves = near.join(own, "v").where("cand <> cur").join(inside, "v", "left").join(held.select(F.col("c").alias("cand"), F.col("dc").alias("d_cand")), "cand")
    gain = gain_numerator(m2, "w", F.coalesce("w_cur", F.lit(0)), "d", "d_cur", "d_cand", num, den)
    return moves.select("v", "cur", "cand", gain.alias("gain"))


def best_moves(moves: DataFrame) -> DataFrame:
    """(v, cur, cand, gain): each vertex's move of largest positive gain, ties to the smallest community."""
    best = moves.where("gain > 0").groupBy("v", "cur").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "cand")).alias("best"))
    return best.select("v", "cur", F.col("best.cand").alias("cand"), (-F.col("best.loss")).alias("gain"))


def accept_disjoint(best: DataFrame) -> DataFrame:
    """Moves that are the best one at both communities that they touch; so their gains add up exactly."""
    touched = best.select("v", "gain", F.explode(F.array("cur", "cand")).alias("c"))
    first = touched.groupBy("c").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "v")).alias("first")).select("c", F.col("first.v").alias("w"))
    at = lambda c: first.select(F.col("c").alias(c), F.col("w").alias(f"v_{c}"))
    return best.join(at("cur"), "cur").join(at("cand"), "cand").where("v = v_cur and v = v_cand").select("v", "cur", "cand", "gain")


def accept_roles(best: DataFrame) -> DataFrame:
    """Moves out of communities whose best move leaves them, into communities whose best move enters them."""
    touched = best.select("v", "gain", F.explode(F.array(F.struct(F.col("cur").alias("c"), F.lit(0).alias("role")), F.struct(F.col("cand").alias("c"), F.lit(1).alias("role")))).alias("t"))
    first = touched.groupBy("t.c").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "v", "t.role")).alias("first")).select("c", F.col("first.role").alias("role"))
    at = lambda c, role: first.where(f"role = {role}").select(F.col("c").alias(c))
    return best.join(at("cur", 0), "cur", "left_semi").join(at("cand", 1), "cand", "left_semi").select("v", "cur", "cand", "gain")


def accept_sure(tried: DataFrame, degree: DataFrame, num: int = 1) -> DataFrame:
    """Of moves accepted by role those that gain by themselves even after all better ones at their communities.

    A move before takes degree from the community left or adds it to the one entered, which costs a later move
    num * d times that degree at most; edges between movers only help it. So all that stay raise the quality together,
    and the moves that are the best at both of their communities are among them.
    """
    earlier = lambda c: F.coalesce(F.sum("d").over(Window.partitionBy(c).orderBy(F.desc("gain"), "v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = tried.join(degree, "v").withColumn("out", earlier("cur")).withColumn("into", earlier("cand"))
    return known.where(F.col("gain") > F.lit(num) * F.col("d") * (F.col("out") + F.col("into"))).select("v", "cur", "cand", "gain")


def applied(mapping: DataFrame, moves: DataFrame) -> DataFrame:
    return mapping.join(moves.select("v", "cand"), "v", "left").select("v", F.coalesce("cand", "c").alias("c"))


def degree_changes(moves: DataFrame, degree: DataFrame) -> DataFrame:
    """(c, change): what moves add to the degree of each community."""
    known = moves.join(degree, "v")
    out = known.select(F.col("cur").alias("c"), (-F.col("d")).alias("d")).unionByName(known.select(F.col("cand").alias("c"), "d"))
    return out.groupBy("c").agg(F.sum("d").alias("change")).where("change <> 0")


def next_frontier(adj: DataFrame, mapping: DataFrame, moves: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """Neighbours of movers outside the mover's new community, and with proposed all that had a move to make."""
    near = moves.select("v", "cand").join(adj, "v").select(F.col("u").alias("v"), "cand").join(mapping, "v").where("c <> cand").select("v")
    return (near if proposed is None else near.unionByName(proposed.select("v"))).distinct()


def quality_numerator(edges: DataFrame, degree: DataFrame, mapping: DataFrame, m2: int, num: int = 1, den: int = 1) -> int:
    """Modularity times den * M^2, in whole numbers."""
    at = lambda end: mapping.select(F.col("v").alias(end), F.col("c").alias(f"c_{end}"))
    inside = edges.join(at("src"), "src").join(at("dst"), "dst").where("c_src = c_dst").agg(F.coalesce(F.sum("w") * 2, F.lit(0)).alias("x")).first()["x"]
    squares = community_degrees(degree, mapping).agg(F.coalesce(F.sum(F.col("dc").cast("decimal(38,0)") * F.col("dc")), F.lit(0)).alias("x")).first()["x"]
    return den * m2 * int(inside) - num * int(squares)


def move(edges: DataFrame, adj: DataFrame, degree: DataFrame, mapping: DataFrame, m2: int, active: DataFrame | None = None, mode: Mode = Mode.DETERMINISTIC, rounds: int | None = None, num: int = 1, den: int = 1, full: bool = False, strict: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """Rounds of movement from mapping: the new mapping, all vertices that moved, and the number of rounds.

    Each round strictly raises the quality: disjoint moves by their gains; in throughput mode many vertices may
    enter one community, and where that does not raise the exact quality the round is done over with those moves
    that are sure to. rounds bounds them; strict raises NotSettled where moves are left then. full looks at every vertex again each round; else only at the frontier.
    """
    moved, n = mapping.select("v").limit(0), 0
    now = quality_numerator(edges, degree, mapping, m2, num, den) if mode is Mode.THROUGHPUT else 0
    while rounds is None or n < rounds + strict:
        best = materialize(best_moves(candidates(adj, mapping, degree, m2, num, den, None if full else active)))
        if best.isEmpty():
            break
        if n == rounds:
            raise NotSettled(f"vertices are left to move after {rounds} rounds")
        n += 1
        chosen = None
        if mode is Mode.THROUGHPUT:
            tried = materialize(accept_roles(best))
            ahead = materialize(applied(mapping, tried))
            then = quality_numerator(edges, degree, ahead, m2, num, den)
            if then > now:
                chosen, after, now = tried, ahead, then
        if chosen is None:
            chosen = materialize(accept_sure(tried, degree, num) if mode is Mode.THROUGHPUT else accept_disjoint(best))
            after = materialize(applied(mapping, chosen))
            if mode is Mode.THROUGHPUT:
                now = quality_numerator(edges, degree, after, m2, num, den)
        mapping = after
        moved = moved.unionByName(chosen.select("v"))
        active = materialize(next_frontier(adj, mapping, chosen, best))
    return mapping, materialize(moved.distinct()), n
