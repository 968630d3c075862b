"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import materialise


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours. Written, so that the join with a hot node's edges can be split."""
    return materialise(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("u", "m").alias("m")), "least")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_steps: int = 200) -> DataFrame:
    """(node, component) for every node with an edge; component is the least node reachable.

    Null ends and loops are ignored; repeated edges count once. Each step writes its edges to the shared folder; a hot
    node's edges are pre-aggregated before they are shuffled, and joins with it can be split at run time.
    """
    clean = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now, last = materialise(clean.distinct(), "edges"), None
    for _ in range(most_steps):  # a safeguard: the steps grow with the logarithm of the longest path
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == last or not state["n"]:
            break
        last = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: each greater neighbour of u points to the least one
        m = _least_neighbour(both)
        large = both.filter("v > u").join(m, F.col("u") == F.col("mu")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        large = materialise(large.distinct(), "large")
        # small star: each lesser neighbour of u, and u, point to the least one
        m = _least_neighbour(large)
        small = large.join(m, F.col("u") == F.col("mu")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        now = materialise(small.unionByName(m.select(F.col("mu").alias("u"), F.col("m").alias("v"))).filter("u > v").distinct(), "small")
    else:
        raise RuntimeError(f"components have not settled after {most_steps} steps")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
