"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweft.llm.common import small, staged


def connected_components(edges: DataFrame, work: str) -> DataFrame:
    """Smallest node of the component of every node that has an edge: ``(node, component)``.

    ``edges`` has long columns ``a`` and ``b``; order, repeats and loops don't matter. An edge is kept as ``a < b``. The star
    rounds need no more of a neighbourhood than its smallest node, ``low(b)``, an aggregation that combines before the
    shuffle: the large star moves an edge to ``(low(a), b)``, the small star to ``(low(b), a)`` and ``(low(b), b)``. ``low`` is
    written first, so each round's joins have one row a node on that side: it is broadcast if it is counted to be
    small, and else AQE can split the edges of a node with many of them. Rounds are written to the shared folder, so the plan
    stays short and an executor can be lost. They grow with the logarithm of the longest path.
    """
    e = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{work}/e0")
    seen = None
    for i in itertools.count(1):
        low = _low(e, f"{work}/l{i}")
        large = staged(e.join(low.select(F.col("node").alias("a"), "m"), "a", "left").select(F.coalesce("m", "a").alias("a"), "b").distinct(), f"{work}/g{i}")
        low = _low(large, f"{work}/s{i}").select(F.col("node").alias("b"), "m")
        moved = large.join(low, "b").select("a", "b", "m").select("m", F.explode(F.array("a", "b")).alias("x")).where("m <> x")
        e = staged(moved.select(F.col("m").alias("a"), F.col("x").alias("b")).distinct(), f"{work}/e{i}")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _low(e: DataFrame, path: str) -> DataFrame:
    """Smallest neighbour of each node that has a smaller one."""
    return small(staged(e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("m")), path))
