"""Louvain communities by rounds of local moves over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweft.operators.running import numbered
from skillweft.sources.staging import shared_path, staged

#: Halves of the vertices that take turns in a round, rounds of a level and levels at most, and what a round has to win.
TURNS, ROUNDS, LEVELS, LEAST_GAIN = 2, 24, 32, 1e-3

#: Tables with a row a vertex are broadcast on levels that were counted to have no more vertices.
BROADCAST_VERTICES = 100_000

Hint = Callable[[DataFrame], DataFrame]


def _moved(edges: DataFrame, state: DataFrame, hint: Hint, m2: float, turn: int, salt: int) -> DataFrame:
    """``state`` after every vertex of this turn went to the neighbouring community of the largest gain.

    The halves are drawn anew in each round, so neighbours that would change places meet in different turns sooner or later; two that are alone
    only join towards the smaller name. Weights to a community and communities' totals are sums that combine before their shuffle,
    so neither a hub nor a large community is a group.
    """
    near = hint(state.select(F.col("id").alias("b"), F.col("c").alias("to")))
    mine = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(TURNS)) == turn
    totals = hint(state.groupBy(F.col("c").alias("to")).agg(F.sum("k").alias("tot"), F.count("*").alias("size")))
    links = edges.join(near, "b").groupBy(F.col("a").alias("id"), "to").agg(F.sum("weight").alias("w"))
    homes = state.where(mine).select("id", F.col("c").alias("to"), F.lit(0.0).alias("w"))  # every vertex may stay
    both = links.unionByName(homes).groupBy("id", "to").agg(F.sum("w").alias("w"))
    each = both.join(totals, "to").join(hint(state.where(mine)), "id")
    home = F.col("to") == F.col("c")
    gain = F.col("w") - (F.col("tot") - F.when(home, F.col("k")).otherwise(0.0)) * F.col("k") / m2
    alone = F.max(F.when(home, F.col("size") == 1))
    best = each.groupBy("id").agg(
        F.max(F.when(home, gain)).alias("stay"),
        F.min(F.when(~home, F.struct((-gain).alias("loss"), F.col("to"), F.col("size")))).alias("best"),
        alone.alias("alone"),
    )
    goes = (-F.col("best.loss") > F.col("stay") + 1e-12) & ~(F.col("alone") & (F.col("best.size") == 1) & (F.col("best.to") > F.col("id")))
    moves = hint(best.where(goes).select("id", F.col("best.to").alias("new")))
    return state.join(moves, "id", "left").select("id", "k", F.coalesce("new", "c").alias("c"))


def _quality(edges: DataFrame, state: DataFrame, hint: Hint, m2: float, loops: float) -> float:
    a, b = (hint(state.select(F.col("id").alias(x), F.col("c").alias(f"c{x}"))) for x in ("a", "b"))
    inside = edges.join(a, "a").join(b, "b").where("ca = cb").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("inside"))
    spread = state.groupBy("c").agg(F.sum("k").alias("tot")).agg(F.sum(F.pow(F.col("tot") / m2, F.lit(2))).alias("spread"))
    row = inside.join(spread, how="cross").first()  # a row each
    return (row["inside"] + loops) / m2 - row["spread"]


def louvain(pairs: DataFrame) -> DataFrame:
    """``id, community`` of weighted pairs ``a, b, weight`` in one or either order; communities are numbered by their smallest id.

    On each level vertices move, in two alternating halves, while a round wins modularity; then a community becomes a vertex, and what lies
    inside it counts on. The best round of a level is kept. State is written after each turn, so plans stay short and executors may be lost. Loops are left out. Without weights every vertex is
    its own community.
    """
    work = shared_path(pairs.sparkSession, "louvain")
    flat = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("weight").cast("double").alias("weight")).distinct()
    edges = staged(flat.unionByName(flat.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).groupBy("a", "b").agg(F.max("weight").alias("weight")), f"{work}/edges")
    state = staged(edges.groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("k")).withColumn("c", F.col("id")), f"{work}/state")
    members, m2, loops = state.select("id", "c"), edges.agg(F.sum("weight")).first()[0] or 0.0, 0.0
    for level in range(LEVELS if m2 > 0 else 0):
        hint: Hint = F.broadcast if state.count() <= BROADCAST_VERTICES else lambda t: t
        best, score = None, _quality(edges, state, hint, m2, loops)
        for r in range(ROUNDS):
            for turn in range(TURNS):
                state = staged(_moved(edges, state, hint, m2, turn, r), f"{work}/{level}-{r}-{turn}")
            now = _quality(edges, state, hint, m2, loops)
            if now <= score + LEAST_GAIN:
                break
            best, score = state, now
        if best is None:
            break
        members = staged(members.join(hint(best.select(F.col("id").alias("c"), F.col("c").alias("to"))), "c").select("id", F.col("to").alias("c")), f"{work}/members{level}")
        a, b = (hint(best.select(F.col("id").alias(x), F.col("c").alias(f"c{x}"))) for x in ("a", "b"))
        merged = staged(edges.join(a, "a").join(b, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("weight").alias("weight")), f"{work}/merged{level}")
        loops += merged.where("a = b").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
        edges = merged.where("a <> b")
        state = staged(best.groupBy("c").agg(F.sum("k").alias("k")).select(F.col("c").alias("id"), "k", "c"), f"{work}/level{level}")
    named = numbered(members.groupBy("c").agg(F.min("id").alias("low")), "low", "community")
    return members.join(named, "c").select("id", (F.col("community") - 1).alias("community"))
