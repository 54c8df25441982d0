"""Connected components by alternating large-star and small-star over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trestle.llm.shared import cut, forget


def _with_min(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the least of u and its neighbours v: a pre-aggregated minimum joined back on u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least.select(F.col("u").alias("w"), "m"), F.col("u") == F.col("w")).select("u", "v", F.least("u", "m").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_min(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    star = _with_min(down)
    moved = star.select(F.col("v").alias("u"), F.col("m").alias("v")).union(star.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame, label: str = "components", most_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the least node reachable) of every node that has an edge to a smaller one.

    ``edges`` has two long columns, u and v; loops and repeated edges do no harm. Each round is written to the shared
    folder, so that its cost doesn't grow and a lost executor loses nothing. Stops when a round changes no edge.
    """
    now = cut(edges.select("u", "v").filter("u <> v").distinct(), label)
    mark = None
    for _ in range(most_rounds):
        after = cut(small_star(large_star(now)), label)
        forget(now)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = seen
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
