"""Connected components of a graph of edges, as alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosodia.llm.shared import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the smallest of them and itself.

    ``large``: those greater than the node; else those not greater, and the node too. Only the minimum of a
    node's neighbours is aggregated (map-side first), so a node with a third of all edges is no burden.
    """
    both = edges if not large else edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # small star: a is the greater end
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """node, root (the least node it is linked with) for every node of ``edges`` (a, b), as longs.

    Each round is written to a scratch table; it ends when a round changes nothing.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(now, "edges")
    mark = None
    for _ in range(most):
        now = materialize(_star(now, large=True), "large")
        now = materialize(_star(now, large=False), "small")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (seen.n, seen.h):
            break
        mark = (seen.n, seen.h)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
