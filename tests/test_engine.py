import pytest
from pyspark.sql import functions as F

from commstream.config import InvalidInput, Mode, NotSettled, RunConfig, resolve
from commstream.operators import graph, refine
from commstream.operators.components import connected_components
from commstream.plans import dynamic, engine, gate, validate
from commstream.plans.quality import modularity
from commstream.sources import edges as reading

FAST = RunConfig(mode=Mode.THROUGHPUT)


def graph_of(spark, rows, n):
    return reading.literal(spark, rows), spark.range(n).select(F.col("id").alias("v"))


def triangles(spark):
    return graph_of(spark, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3, 0.05)], 6)


def groups(partition):
    found = {}
    for r in partition.collect():
        found.setdefault(r["c"], set()).add(r["v"])
    return sorted(map(sorted, found.values()))


def test_two_triangles(spark):
    edges, vertices = triangles(spark)
    out = engine.run(edges, vertices, scale=100)
    assert groups(out.partition()) == [[0, 1, 2], [3, 4, 5]]
    assert round(out.quality, 6) == 0.491736
    level = out.state.levels[0]
    assert validate.disconnected_subs(level.edges, level.subs, level.mapping).isEmpty()
    assert validate.nesting_violations(level.subs, level.mapping).isEmpty()


def test_edge_free_and_isolated(spark):
    edges, vertices = graph_of(spark, [], 3)
    out = engine.run(edges, vertices)
    assert groups(out.partition()) == [[0], [1], [2]]
    assert out.quality == 0


def test_maintain_insert_and_delete_restores_the_graph(spark):
    edges, vertices = triangles(spark)
    before = engine.run(edges, vertices, FAST, scale=100)
    delta = spark.createDataFrame([(2, 3, 500), (5, 6, 100)], "src long, dst long, w long")
    after = engine.maintain(before.state, delta, 0, FAST)
    assert {r["v"] for r in after.partition().collect()} == set(range(7))
    back = engine.maintain(after.state, delta.select("src", "dst", (-F.col("w")).alias("w")), 1, FAST)
    assert graph.difference(before.state.levels[0].edges, back.state.levels[0].edges).isEmpty()
    for a, b in zip(after.state.levels, after.state.levels[1:], strict=False):
        assert validate.conservation_violations(a.edges, a.subs, b.edges).isEmpty()
    again = engine.maintain(back.state, delta, 1, FAST)
    assert again.state is back.state


def test_bad_input(spark):
    edges, vertices = graph_of(spark, [(0, 9)], 2)
    with pytest.raises(InvalidInput):
        engine.run(edges, vertices)
    with pytest.raises(InvalidInput):
        RunConfig(max_iterations=0).checked()
    bad = spark.createDataFrame([("1 2",), ("1 x",), ("# note",), ("3\t4 0.5",)], "value string")
    assert reading.parsed(bad).where("not ok").count() == 1


def test_fallback_and_gate(spark):
    assert resolve(RunConfig(accelerated=True)).fallback_reason == "ACCEL_UNAVAILABLE"
    runs = spark.createDataFrame([("p", False, "live"), ("p", True, "live"), ("p", True, "file")], "profile_id string, pinned boolean, source string")
    assert [r["reason"] for r in gate.eligible(runs).collect()] == [gate.UNPINNED, gate.LIVE, None]


def test_ring_split(spark):
    ring = spark.range(100).select(F.col("id").alias("src"), ((F.col("id") + 1) % 100).alias("dst"), F.lit(1).cast("long").alias("w"))
    parts = dynamic.split(ring, 0.8, 5, 4)
    assert [(r["batch_id"], r["total_edges"]) for r in dynamic.batch_totals(parts).orderBy("batch_id").collect()] == [(-1, 80), (0, 85), (1, 90), (2, 95), (3, 100)]


def test_components_and_self_loops(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 9), (None, 1), (8, 7)], "a long, b long")
    for small in (0, 1, 100):
        assert {(r["v"], r["component"]) for r in connected_components(e, small_edges=small).collect()} == {(3, 3), (4, 3), (5, 3), (9, 9), (7, 7), (8, 7)}
    assert connected_components(e.limit(0)).count() == 0


def test_modularity_of_two_pairs(spark):
    e, v = graph_of(spark, [(0, 1), (2, 3)], 4)
    f = v.select("v", (F.col("v") - F.col("v") % 2).alias("c"))
    assert modularity(graph.weighted(e), f).first()["q"] == 0.5


def test_many_lone_vertices_merge_in_a_round(spark):
    e, v = graph_of(spark, [(0, i) for i in range(1, 13)], 13)
    e = graph.weighted(e)
    whole = v.select("v", (F.col("v") * 0).alias("c")), graph.degrees(e, v), graph.twice_total(e)
    alone = v.select("v", F.col("v").alias("s"))
    subs, merged = refine.merge(graph.neighbours(e), alone, *whole, rounds=3)
    assert subs.select("s").distinct().count() == 1 and merged.count() == 12
    with pytest.raises(NotSettled):
        refine.merge(graph.neighbours(e), alone, *whole, rounds=1)
