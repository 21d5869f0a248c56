"""Few rounds where many vertices leave one heavy community, and maintenance that ends in one task."""

import random

import numpy as np
import pandas as pd

from commstream.config import Mode, RunConfig
from commstream.operators import local, movement
from commstream.plans import engine

FAST = RunConfig(mode=Mode.THROUGHPUT)
LEAVES = 600


def heavy():
    """Leaves of a hub that all stand in its community and gain by moving to their second neighbour until it is as heavy."""
    rows = [(0, 0, 500), (1, 1, 500)] + [(0, i, 3) for i in range(2, LEAVES + 2)] + [(1, i, 2) for i in range(2, LEAVES + 2)]
    return pd.DataFrame(rows, columns=["src", "dst", "w"], dtype="int64"), [0, 1] + [0] * LEAVES


def test_many_leave_a_heavy_community_in_few_rounds(spark):
    edges, start = heavy()
    g = local.graph_of(edges, np.arange(LEAVES + 2))
    c, _, rounds = local.move(g, np.array(start), FAST)
    assert rounds < 40 and len(np.unique(c)) == 2
    rows = spark.createDataFrame(edges)
    mapping = spark.createDataFrame([(i, int(x)) for i, x in enumerate(start)], "v long, c long")
    adj, degree = movement.materialize(engine.graph.neighbours(rows)), movement.materialize(engine.graph.degrees(rows))
    found, _, n = movement.move(rows, adj, degree, mapping, g.m2, None, Mode.THROUGHPUT)
    assert n == rounds and sorted(map(tuple, found.collect())) == list(enumerate(c.tolist()))


def test_sure_moves_raise_the_quality_together():
    rng = np.random.default_rng(5)
    for seed in range(20):
        rnd = random.Random(seed)
        pairs = {(a, b) for a, b in ((rnd.randrange(60), rnd.randrange(60)) for _ in range(300)) if a < b}
        edges = pd.DataFrame([(a, b, rnd.randint(1, 5)) for a, b in sorted(pairs)], columns=["src", "dst", "w"], dtype="int64")
        g, c, k = local.graph_of(edges, np.arange(60)), rng.integers(0, 6, 60), 6
        v, cand, w = local.near_sums(g.row, c[g.col], g.weight, k)
        dc, inside = local.summed(c, g.degree, k), np.zeros(60, np.int64)
        inside[v[cand == c[v]]] = w[cand == c[v]]
        v, cand, w = v[cand != c[v]], cand[cand != c[v]], w[cand != c[v]]
        best = local.best_of(v, c[v], cand, g.m2 * (w - inside[v]) + g.degree[v] * (dc[c[v]] - g.degree[v] - dc[cand]))
        if not len(best[0]):
            continue
        take = local.sure(*best, g.degree[best[0]], local.accepted(*best, k, True), 1)
        alone = local.accepted(*best, k, False)
        after = c.copy()
        after[best[0][take]] = best[2][take]
        assert take[alone].all() and local.quality(g, after, k, FAST) > local.quality(g, c, k, FAST)


def test_maintenance_ends_in_one_task_where_a_level_fits(spark, monkeypatch):
    rng, rows = random.Random(1), {}
    for _ in range(50):
        a, b = rng.randrange(24), rng.randrange(24)
        rows[min(a, b), max(a, b)] = rng.randint(1, 4)
    edges, vertices = spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], "src long, dst long, w long"), spark.range(27).withColumnRenamed("id", "v")
    delta = spark.createDataFrame([(0, 23, 3), (24, 26, 2), (5, 26, 1)], "src long, dst long, w long")
    whole = engine.run(edges, vertices, RunConfig(mode=Mode.THROUGHPUT, levels=3))
    assert len(whole.state.levels) > 2
    most = max(whole.state.levels[1].edges.count() + 12, whole.state.levels[1].mapping.count())
    assert most < edges.count()
    some, calls, move = RunConfig(mode=Mode.THROUGHPUT, levels=3, local_edges=most), [], movement.move
    state = engine.run(edges, vertices, some).state
    monkeypatch.setattr(movement, "move", lambda *a, **k: calls.append(1) or move(*a, **k))
    out, other = engine.maintain(state, delta, 0, some), engine.maintain(whole.state, delta, 0, RunConfig(mode=Mode.THROUGHPUT, levels=3))
    assert len(calls) == 1
    assert sorted(map(tuple, out.partition().collect())) == sorted(map(tuple, other.partition().collect()))
    assert [sorted(map(tuple, x.edges.collect())) for x in out.state.levels] == [sorted(map(tuple, x.edges.collect())) for x in other.state.levels]
