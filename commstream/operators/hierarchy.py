"""Mappings across levels: communities pushed down, paths up the tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def push_down(subs: list[DataFrame], top: DataFrame, changed: DataFrame | None = None, before: list[DataFrame] | None = None) -> list[DataFrame]:
    """Communities (v, c) of every level from those of the top one, through subs[p]: (v, s) of level p.

    With changed (vertices of the top level) and the mappings before, only their members are looked up anew.
    """
    out = [top]
    for p in range(len(subs) - 1, -1, -1):
        up = subs[p].join(out[0].select(F.col("v").alias("s"), "c"), "s").select("v", "c")
        if changed is not None and before is not None:
            changed = subs[p].join(changed.select(F.col("v").alias("s")), "s", "left_semi").select("v")
            anew = up.join(changed, "v", "left_semi").select("v", F.col("c").alias("new"))
            up = before[p].join(anew, "v", "left").select("v", F.coalesce("new", "c").alias("c"))
        out.insert(0, up)
    return out


def tree(subs: list[DataFrame]) -> DataFrame:
    """(level, child, parent) of all levels."""
    levels = [s.select(F.lit(p).alias("level"), F.col("v").alias("child"), F.col("s").alias("parent")) for p, s in enumerate(subs)]
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def paths(subs: list[DataFrame]) -> DataFrame:
    """(v, l1 ... lP): the sub-community of each vertex at every level."""
    out = subs[0].select("v", F.col("s").alias("l1"))
    for p, s in enumerate(subs[1:], 2):
        out = out.join(s.select(F.col("v").alias(f"l{p - 1}"), F.col("s").alias(f"l{p}")), f"l{p - 1}")
    return out.select("v", *[f"l{p}" for p in range(1, len(subs) + 1)])
