"""Entry points: cluster a graph, and keep the clusters of a changing graph."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commstream.config import InvalidInput, Mode, NotSettled, Resolution, RunConfig, Storage, resolve
from commstream.functions.gain import fits
from commstream.operators import graph, local, movement, refine
from commstream.operators.aggregate import delta_superedges, relabelled, supergraph
from commstream.operators.hierarchy import push_down
from commstream.plans.quality import modularity
from commstream.storage import materialize


@dataclass
class Level:
    """edges(src, dst, w), communities(v, c) and sub-communities(v, s) of one level; s are the vertices above."""

    edges: DataFrame
    mapping: DataFrame
    subs: DataFrame
    rounds: int = 0


@dataclass
class State:
    levels: list[Level]
    batch_id: int = -1
    #: All levels as rows of local.TABLE, where one task settled them, and how many edges the lowest one has.
    table: DataFrame | None = None
    n_edges: int = 0

    def communities(self) -> DataFrame:
        """(v, c): the community of every vertex, from the top level down."""
        if self.table is not None:
            return _kind(self.table, 0, local.PARTITION, "v", "c")
        return push_down([x.subs for x in self.levels[:-1]], self.levels[-1].mapping)[0]

    def refined(self) -> DataFrame:
        """(v, s): the connected sub-community of every vertex at the lowest level."""
        return self.levels[0].subs


@dataclass
class Outcome:
    state: State
    quality: float
    n_communities: int
    rounds: int
    seconds: float
    resolution: Resolution
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def partition(self) -> DataFrame:
        return self.state.communities()


def _kind(table: DataFrame, level: int, kind: int, *names: str) -> DataFrame:
    own = table.where((F.col("level") == level) & (F.col("kind") == kind))
    return own.select(*[F.col(c).alias(n) for c, n in zip("abw", names, strict=False)])


def _rows(level: int, kind: int, df: DataFrame) -> DataFrame:
    """df, of one to three columns, as rows of local.TABLE."""
    own = [F.col(c).cast("long") for c in df.columns] + [F.lit(0).cast("long")] * (3 - len(df.columns))
    return df.select(F.lit(level).alias("level"), F.lit(kind).alias("kind"), *[c.alias(n) for c, n in zip(own, "abw", strict=True)])


def _in_one_task(rows: DataFrame, config: RunConfig, first: int, maintains: bool) -> DataFrame:
    """local.TABLE of what one task makes of rows, which are of a checked number."""
    out = materialize(rows.coalesce(1).mapInPandas(local.task(config, first, maintains), local.TABLE))
    failed = out.where(F.col("kind") == local.FAILED).orderBy("level").select("a").collect()
    if failed:
        name, _, text = bytes(r["a"] for r in failed).decode().partition(":")
        raise {"NotSettled": NotSettled, "InvalidInput": InvalidInput}[name](text)
    return out


def _levels_of(table: DataFrame) -> list[Level]:
    rounds = {r["level"]: r["a"] for r in table.where(F.col("kind") == local.ROUNDS).collect()}
    return [Level(_kind(table, i, local.EDGES, "src", "dst", "w"), _kind(table, i, local.MAPPING, "v", "c"), _kind(table, i, local.SUBS, "v", "s"), n) for i, n in sorted(rounds.items())]


def _local_outcome(table: DataFrame, batch_id: int, config: RunConfig, began: float) -> Outcome:
    told = {r["level"]: r for r in table.where(F.col("kind") == local.SUMMARY).collect()}
    m2, state = told[0]["w"], State(_levels_of(table), batch_id, table, told[1]["w"])
    q = told[0]["a"] / m2 - config.gamma_num / config.gamma_den * float(told[0]["b"]) / (float(m2) * m2) if m2 > 0 else 0.0
    return Outcome(state, q, told[1]["a"], told[1]["b"], time.time() - began, resolve(config))


def _upper_rows(levels: list[Level], first: int, delta: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of local.TABLE of the levels from first on, and of what changed below: delta and the vertices of first."""
    out = _rows(first, local.DELTA, delta.select("src", "dst", "w")).unionByName(_rows(first, local.VERTICES, present.select("v")))
    for i, x in enumerate(levels[first:], first):
        for kind, df in ((local.EDGES, x.edges.select("src", "dst", "w")), (local.MAPPING, x.mapping.select("v", "c")), (local.SUBS, x.subs.select("v", "s"))):
            out = out.unionByName(_rows(i, kind, df))
    return out


def _level(edges: DataFrame, vertices: DataFrame, start: DataFrame, config: RunConfig) -> Level:
    adj, degree = materialize(graph.neighbours(edges)), materialize(graph.degrees(edges, vertices))
    m2 = graph.twice_total(edges)
    if not fits(m2, config.gamma_num, config.gamma_den):
        raise InvalidInput(f"a total weight of {m2} is too large for exact gains; use a smaller scale")
    mapping, _, rounds = movement.move(edges, adj, degree, start, m2, None, config.mode, config.max_iterations, config.gamma_num, config.gamma_den, strict=True)
    alone = vertices.select("v", F.col("v").alias("s"))
    subs, _ = refine.merge(adj, alone, mapping, degree, m2, config.gamma_num, config.gamma_den, rounds=config.max_iterations)
    return Level(edges, mapping, subs, rounds)


def run(edges: DataFrame, vertices: DataFrame, config: RunConfig | None = None, scale: int = 1) -> Outcome:
    """Cluster edges(src, dst[, weight]) over vertices(v): levels of movement, refinement and aggregation.

    Weights are made whole numbers by scale. Isolated vertices are communities of their own.
    """
    config, began = (config or RunConfig()).checked(), time.time()
    vertices = materialize(vertices.select(F.col("v").cast("long").alias("v")).distinct())
    edges = edges if "w" in edges.columns else graph.weighted(edges, scale)
    graph.check_endpoints(edges, vertices)
    edges = graph.check_weights(materialize(graph.compress(edges)))
    if config.storage is Storage.DISK:
        edges = edges.persist(StorageLevel.DISK_ONLY)
    levels, own, mapping = [], vertices, vertices.select("v", F.col("v").alias("c"))
    for n in range(config.levels):
        if max(edges.count(), own.count()) <= config.local_edges:
            table = _in_one_task(_rows(n, local.EDGES, edges.select("src", "dst", "w")).unionByName(_rows(n, local.MAPPING, mapping.select("v", "c"))), config, n, False)
            if n == 0:
                return _local_outcome(table, -1, config, began)
            levels += _levels_of(table)
            break
        level = _level(edges, own, mapping, config)
        levels.append(level)
        above = materialize(level.subs.select(F.col("s").alias("v")).distinct())
        if above.count() == own.count():
            break
        mapping = materialize(relabelled(level.mapping, level.subs))
        edges, own = materialize(supergraph(edges, level.subs)), above
    state = State(levels)
    return _outcome(state, config, began)


def _outcome(state: State, config: RunConfig, began: float) -> Outcome:
    found = materialize(state.communities())
    row = modularity(state.levels[0].edges, found, config.gamma_num, config.gamma_den).first()
    return Outcome(state, float(row["q"]), int(row["n_communities"]), sum(x.rounds for x in state.levels), time.time() - began, resolve(config))


def maintain(state: State, delta: DataFrame, batch_id: int, config: RunConfig | None = None) -> Outcome:
    """The state after weight changes delta(src, dst, w): only what they touch moves, is split, merged and lifted.

    A batch that the state already holds is not applied again. Vertices first seen in delta join as communities of
    their own; a weight that would become negative is an error. Each level hands its superedge changes to the next.
    """
    config, began = (config or RunConfig()).checked(), time.time()
    if batch_id <= state.batch_id:
        return _outcome(state, config, began)
    if state.table is not None:
        delta = materialize(delta.select("src", "dst", "w"))
        if state.n_edges + delta.count() <= config.local_edges:
            held = state.table.where(F.col("kind").isin(local.EDGES, local.MAPPING, local.SUBS)).select("level", "kind", "a", "b", "w")
            return _local_outcome(_in_one_task(held.unionByName(_rows(0, local.DELTA, delta)), config, 0, True), batch_id, config, began)
    num, den, levels = config.gamma_num, config.gamma_den, []
    delta = materialize(graph.compress(delta))
    present = None
    for n, old in enumerate(state.levels):
        if n and max(old.edges.count() + delta.count(), present.count()) <= config.local_edges:
            levels += _levels_of(_in_one_task(_upper_rows(state.levels, n, delta, present), config, n, True))
            break
        edges = graph.check_weights(materialize(graph.apply_delta(old.edges, delta)))
        ends = delta.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
        vertices = old.mapping.select("v").unionByName(ends).distinct() if present is None else present
        vertices = materialize(vertices)
        start = materialize(vertices.join(old.mapping, "v", "left").select("v", F.coalesce("c", "v").alias("c")))
        subs = materialize(vertices.join(old.subs, "v", "left").select("v", F.coalesce("s", "v").alias("s")))
        adj, degree, m2 = materialize(graph.neighbours(edges)), materialize(graph.degrees(edges, vertices)), graph.twice_total(edges)
        if not fits(m2, num, den):
            raise InvalidInput(f"a total weight of {m2} is too large for exact gains")
        active = materialize(movement.activated(delta, start))
        mapping, moved, rounds = movement.move(edges, adj, degree, start, m2, active, config.mode, config.max_iterations, num, den, strict=True)
        touched = materialize(movement.affected(delta, subs).unionByName(moved).distinct())
        now, parted = refine.split(edges, subs, mapping, touched)
        fresh = vertices.join(old.subs.select("v"), "v", "left_anti")
        now, _ = refine.merge(adj, now, mapping, degree, m2, num, den, parted.unionByName(fresh).distinct(), config.max_iterations)
        levels.append(Level(edges, mapping, now, rounds))
        delta = materialize(delta_superedges(edges, delta, subs, now))
        present = materialize(now.select(F.col("s").alias("v")).distinct())
    return _outcome(State(levels, batch_id), config, began)


def changes(before: DataFrame, after: DataFrame, batch_id: int) -> DataFrame:
    """(batch_id, v, old, new) of every vertex whose community differs; null: not there."""
    both = before.select("v", F.col("c").alias("old")).join(after.select("v", F.col("c").alias("new")), "v", "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(F.lit(batch_id).cast("long").alias("batch_id"), "v", "old", "new")


def run_default(edges: DataFrame, vertices: DataFrame) -> Outcome:
    return run(edges, vertices)


def run_scratch(edges: DataFrame, vertices: DataFrame) -> Outcome:
    """The from-scratch baseline that maintenance is compared with."""
    return run(edges, vertices, RunConfig(mode=Mode.THROUGHPUT))
