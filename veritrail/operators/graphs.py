"""Distances in graphs of edges (a, b), by joins with the frontier."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.sources.storage import written


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once, without loops."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.filter("a <> b").distinct()


def distances(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(node, hops): fewest edges from any source (node) to each node that has a path, or one within most; every round is written, so lineage stays short."""
    edges = written(undirected(edges))
    reached = frontier = written(sources.select("node").distinct().withColumn("hops", F.lit(0)))
    for hops in itertools.count(1) if most is None else range(1, most + 1):
        step = frontier.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        frontier = written(step.join(reached, "node", "left_anti").withColumn("hops", F.lit(hops)))
        if frontier.isEmpty():
            break
        reached = written(reached.unionByName(frontier)) if hops % 20 == 0 else reached.unionByName(frontier)
    return reached
