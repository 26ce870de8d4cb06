"""Connected components of a graph given by its edges, in alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterlens.llm.common import stored


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node reachable) for every node of an edge.

    Large star: each node hands its larger neighbours to its smallest one; small star: it hands its smaller
    neighbours to the smallest. Both keep components whole and the number of edges does not grow; rounds are
    logarithmic in the size of a component. Every round is written to the shared folder. Nodes with many edges
    are met by partial minima and joins that can be split.

    Edge cases: repeated edges, edges given both ways and loops change nothing (a node with loops alone has no row); an edge with a
    null end is left out; no edges give no rows; nodes may be of any type that has an order."""
    e = stored(edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter("u <> v").distinct(), "edges")
    before = _state(e)
    while True:
        both = e.select("u", "v").union(e.select("v", "u")).toDF("x", "y")
        low = stored(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), "least")
        large = both.filter("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large, "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        down = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(down.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = _state(e)
        if state == before:
            break
        before = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
