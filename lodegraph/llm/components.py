"""Connected components of an undirected graph, held in tables from first to last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, forget, written


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the least node reachable.

    Alternates the large-star and small-star steps: each node's larger neighbours, then each node and its smaller
    neighbours, move to the least neighbour, until every node hangs on its component's least node. Steps pre-aggregate
    minima before they shuffle; what a step joins is written first, so that the join with a node of very many neighbours can be
    split, and nothing is computed twice. Self-loops and repeated edges are fine,
    null ends are dropped, no edges give no rows.
    """
    now = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    for _ in range(rounds):
        if now.isEmpty():
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = written(both.join(apart(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        smallest = written(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(apart(smallest), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(smallest.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, name)
        mark = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
        same = after.agg(*mark).first() == now.agg(*mark).first()
        forget(now, least, large, smallest)
        now = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
