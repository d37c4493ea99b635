"""Connected components of an undirected graph given as rows of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Rounds whose maps are joined before the result is written.
TOGETHER = 6


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its smallest node.

    Each round maps every node to the first of its closed neighbourhood and replaces the edges by those between these first nodes.
    The first round orders nodes by themselves, which collapses stars around a smallest node; every later one by a hash that differs
    from round to round. That order is random whatever the ids, so a graph of any shape loses a constant share of its nodes a round
    (about half on a path), and rounds follow the logarithm of the number of nodes. The rounds' maps are put together from the last,
    smallest one back, and the smallest node of each component is taken at the end. A hub costs one row per edge; minima combine
    before shuffles. Null ends, self loops and repeated edges are ignored. Empty edges give no rows.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    rounds, edges_before = [], []
    while True:
        both = stored(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
        discard(*edges_before)
        edges_before = [both]
        if both.isEmpty():
            discard(both)
            break
        # The hash of one long is a permutation, so no two nodes tie.
        own, other = ((F.xxhash64(c, F.lit(len(rounds))) if rounds else F.col(c)) for c in ("u", "v"))
        near = both.groupBy("u").agg(F.min(other).alias("p"), F.min_by("v", other).alias("near"))
        first = stored(near.select("u", F.when(F.col("p") < own, F.col("near")).otherwise(F.col("u")).alias("m")), "first")
        rounds.append(first)
        moved = both.where("u < v").join(first, "u").select(F.col("m").alias("x"), "v")
        pairs = moved.join(first.withColumnRenamed("u", "v"), "v").select(F.col("x").alias("u"), F.col("m").alias("v")).where("u <> v")
    if not rounds:
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    labels = rounds[-1].select(F.col("u").alias("node"), F.col("m").alias("top"))
    scratch = [*rounds]
    for n, first in enumerate(rounds[-2::-1], 1):
        above = labels.select(F.col("node").alias("m"), "top")
        labels = first.join(above, "m", "left").select(F.col("u").alias("node"), F.coalesce("top", "m").alias("top"))
        if n % TOGETHER == 0:
            labels = stored(labels, "labels")
            scratch.append(labels)
    labels = stored(labels, "labels")
    discard(*scratch)
    least = labels.groupBy("top").agg(F.min("node").alias("component"))
    return labels.join(least, "top").select("node", "component")
