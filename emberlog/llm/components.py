"""Connected components by alternating large-star and small-star steps, each a few joins and grouped minima.

Only links are moved. The links of a node that has very many are joined by broadcast, so no task gets them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.shared import hot_join, scratch, stored

#: More steps than any graph of fewer than 2 ** 64 nodes should need; without an end by then, something is wrong.
MOST_STEPS = 200


def _star(edges: DataFrame, n: int, large: bool, path: str) -> DataFrame:
    """One step over n edges: the larger (or all smaller) neighbours of each node are linked to the smallest node around it."""
    both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), f"{path}-least")
    joined = hot_join(both, least, "a", "n", 2 * n)
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b): the smallest node that it is connected with.

    Null ends and links of a node with itself don't count. No links give no row.
    """
    path = scratch(links.sparkSession, "components")
    edges = stored(links.select("a", "b").where("a != b").distinct(), f"{path}/0")
    before = edges.agg(F.count("*"), F.lit(None)).first()
    for step in range(1, MOST_STEPS + 1):
        edges = stored(_star(edges, before[0], True, f"{path}/{step}-large"), f"{path}/{step}-half")
        edges = stored(_star(edges, before[0], False, f"{path}/{step}-small"), f"{path}/{step}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        before = now
    raise RuntimeError(f"components did not settle in {MOST_STEPS} steps")
