"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. `edges` (a, b), a > b.

    large: every larger neighbour of a node links to the smallest node of its neighbourhood.
    small: every smaller neighbour of a node links to the smallest of them.
    The minimum is a map-side combined aggregate and the join back can be split by AQE, so a hub is never gathered.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        out = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        out = edges.join(low, "a").filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        out = out.union(low.select("a", F.col("low").alias("b")))
    return out.distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of each node's component, for every node that has a smaller one in its component.

    Links may repeat, point either way or join a node to itself; null ends are ignored. Every round is written to the
    shared folder, so the plan stays short and a lost executor costs one round.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct()
    edges = stored(edges, "links")
    seen = None
    for _ in range(max_rounds):
        edges = stored(_star(_star(edges, large=True), large=False), "star")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        seen = tuple(mark)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
