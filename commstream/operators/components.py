"""Connected components by repeated contraction, as joins and partial aggregates; small remainders end in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commstream.operators.local import components
from commstream.storage import materialize

#: So many edges at most are finished in one task.
SMALL_EDGES = 500_000


def _finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(v, p): the smallest id that each end of the edges reaches."""
    edges = pd.concat(list(frames), ignore_index=True)
    v, at = np.unique(edges[["a", "b"]].to_numpy(np.int64), return_inverse=True)
    at = at.reshape(-1, 2)
    yield pd.DataFrame({"v": v, "p": v[components(len(v), at[:, 0], at[:, 1])]})


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", small_edges: int = SMALL_EDGES) -> DataFrame:
    """(v, component) for every vertex with an edge; component is the smallest id reachable.

    Each round hooks every vertex to its smallest neighbour, follows the hooks to their roots by pointer
    doubling, and contracts the edges, until small_edges are left at most. Self-loops keep their vertex, null ends
    are dropped, repeated edges count once; an empty input gives an empty result.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna()
    live = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    left, labels = live.count(), None
    while left > small_edges or (labels is None and left and not small_edges):
        if labels is None:
            labels = materialize(live.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("component", F.col("v")))
            live = live.where("a <> b")
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")).withColumnRenamed("a", "v"))
        while True:
            up = hooks.select(F.col("v").alias("p"), F.col("p").alias("q"))
            jumped = materialize(hooks.join(up, "p").select("v", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
            hooks = jumped.select("v", "p")
            if jumped.where("moved").isEmpty():
                break
        at = hooks.select(F.col("v").alias("component"), "p")
        labels = materialize(labels.join(at, "component", "left").select("v", F.coalesce("p", "component").alias("component")))
        ha, hb = hooks.select(F.col("v").alias("a"), F.col("p").alias("pa")), hooks.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        live = live.join(ha, "a").join(hb, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        live = materialize(live.where("a <> b").distinct())
        left = live.count()
    if not left:
        return live.select(F.col("a").alias("v"), F.col("b").alias("component")) if labels is None else labels
    done = live.coalesce(1).mapInPandas(_finish, "v long, p long")
    if labels is None:
        return materialize(done.select("v", F.col("p").alias("component")))
    done = materialize(done.select(F.col("v").alias("component"), "p"))
    return labels.join(done, "component", "left").select("v", F.coalesce("p", "component").alias("component"))
