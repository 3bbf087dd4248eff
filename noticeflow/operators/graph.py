"""Connected components of an undirected graph, for any shape and size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.storage import cut


def _nearest(edges: DataFrame) -> DataFrame:
    """Both directions of the edges (a, b), beside the smallest of a and its neighbours. The minimum is aggregated before
    the shuffle; the join back is an equi-join that adaptive execution splits where a has very many neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    return both.join(least, "a")


def components(edges: DataFrame, nodes: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node that edges (a, b) connect with node, itself included.

    Every round links larger neighbours of a node to the smallest one, then smaller ones: trees flatten to stars in
    O(log n) rounds on paths and much fewer elsewhere. Each round is kept in the shared folder; two that agree end it.
    Null ends and loops connect nothing; nodes without edges are their own root; repeated nodes and edges count once.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before, flat = mark(now), False
    for _ in range(rounds):
        large = _nearest(now).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        # the smaller neighbours of a node, and itself, go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
        now = cut(small.where("a <> b").distinct())
        after = mark(now)
        if after == before:
            flat = True
            break
        before = after
    if not flat:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return nodes.where("node is not null").select("node").distinct().join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
