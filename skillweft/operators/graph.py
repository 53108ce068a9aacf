"""The position-skill graph: expansion, co-occurrence, upkeep, versions and algorithms.

Vertices are ``id, label, name``; edges ``src, dst`` with their properties.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillweft.functions import text as X
from skillweft.sources.staging import shared_path, small, staged


def expand(edges: DataFrame, positions: DataFrame, least: float = 0.0) -> DataFrame:
    """Edges of the given positions (``position_name``) with at least that weight."""
    return edges.where(F.col("weight") >= least).join(positions.select("position_name"), "position_name", "left_semi")


def panorama(edges: DataFrame, freqs: DataFrame, n: int) -> DataFrame:
    """Edges of the ``n`` most frequent positions; the limit comes before the expansion."""
    return edges.join(F.broadcast(freqs.orderBy(F.desc("freq"), "position_name").limit(n)), "position_name")


def tech_stack(edges: DataFrame, n: int) -> DataFrame:
    """Edges into the ``n`` skills with the most positions."""
    top = edges.groupBy("skill").agg(F.countDistinct("position_name").alias("degree")).orderBy(F.desc("degree"), "skill").limit(n)
    return edges.join(F.broadcast(top), "skill")


def graph_view(edges: DataFrame, freqs: DataFrame, view: str, n: int, level: str | None = None) -> DataFrame:
    """V4: one of the views, or both of them together as distinct edges; ``level`` filters the positions by a word."""
    parts = {"panorama": panorama(edges, freqs, n).select("position_name", "skill"), "techStack": tech_stack(edges, n).select("position_name", "skill")}
    rows = parts[view] if view in parts else parts["panorama"].unionByName(parts["techStack"]).distinct()
    return rows if level is None else rows.where(F.col("position_name").contains(level))


def reverse(edges: DataFrame, skill: str) -> DataFrame:
    """Positions that require a skill."""
    return edges.where(F.col("skill") == skill).select("position_name", "weight")


def evidence_refs(edges: DataFrame, evidence: DataFrame, per_skill: int = 3, cap: int = 20) -> DataFrame:
    """Evidence of a position's skills: one of each source, ``per_skill`` sources, and no new skill from ``cap`` rows on.

    ``edges``: ``position_name, skill, weight``; ``evidence``: ``skill, source, ref``. Skills go by weight and name.
    """
    one = evidence.groupBy("skill", "source").agg(F.min("ref").alias("ref"))
    some = one.withColumn("k", F.row_number().over(Window.partitionBy("skill").orderBy("source"))).where(F.col("k") <= per_skill)
    n = some.groupBy("skill").agg(F.count("*").alias("n"))
    order = Window.partitionBy("position_name").orderBy(F.desc("weight"), "skill")
    before = edges.join(n, "skill").withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < cap)
    return before.join(some, "skill").select("position_name", "skill", "source", "ref", F.least(F.col("n") / 8.0, F.lit(1.0)).alias("confidence"))


def skill_detail(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distinct positions and evidence of each skill; both are counted before they are joined, so rows don't multiply."""
    p = edges.groupBy("skill").agg(F.countDistinct("position_name").alias("positions"))
    e = evidence.groupBy("skill").agg(F.countDistinct("ref").alias("evidence"))
    return p.join(e, "skill", "full").select("skill", F.coalesce("positions", F.lit(0)).alias("positions"), F.coalesce("evidence", F.lit(0)).alias("evidence"))


def cooccurrence(edges: DataFrame, least: int = 1) -> DataFrame:
    """Positions that two skills share, as ``a, b, weight`` with a < b.

    Pairs are as many as the squares of the positions' skills, which a position's vocabulary bounds.
    """
    d = edges.select("position_name", "skill").distinct()
    pairs = d.toDF("position_name", "a").join(d.toDF("position_name", "b"), "position_name").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def adjacency(pairs: DataFrame) -> DataFrame:
    """Both directions of weighted pairs."""
    return pairs.select("a", "b", "weight").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """``id, out_degree, in_degree``."""
    out, into = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o")), edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
    return out.join(into, "id", "full").select("id", F.coalesce("o", F.lit(0)).alias("out_degree"), F.coalesce("i", F.lit(0)).alias("in_degree"))


def filtered_skills(edges: DataFrame, stopwords: DataFrame, whitelist: DataFrame, least: int = 2) -> DataFrame:
    """Edges without stop-word skills and without skills off the whitelist that fewer than ``least`` positions require."""
    degree = edges.groupBy("skill").agg(F.count("*").alias("n"))
    keep = degree.join(whitelist.select("skill", F.lit(True).alias("white")).distinct(), "skill", "left").where(F.col("white") | (F.col("n") >= least)).select("skill")
    return edges.join(stopwords.select("skill"), "skill", "left_anti").join(keep, "skill", "left_semi")


def merge_vertices(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with positions merged by standard name: the smallest name stays, and the first of its edges to a skill.

    ``names``: ``position_name, standard``; positions without a standard name go.
    """
    kept = names.where(F.coalesce("standard", F.lit("")) != "").withColumn("primary", F.min("position_name").over(Window.partitionBy("standard"))).select("position_name", "primary")
    w = Window.partitionBy("primary", "skill").orderBy(F.when(F.col("position_name") == F.col("primary"), 0).otherwise(1), "position_name")
    return edges.join(kept, "position_name").withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.col("primary").alias("position_name"), "skill", "weight")


def relations(new: DataFrame, vertices: DataFrame, both_ways: bool = False) -> DataFrame:
    """Relation edges whose ends exist; alternatives count in both directions."""
    ends = vertices.select("id")
    e = new.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    return (e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if both_ways else e).distinct()


def relabelled(edges: DataFrame, old: str, new: str) -> DataFrame:
    """Edges of a type under another name, once each."""
    return edges.withColumn("type", F.when(F.col("type") == old, new).otherwise(F.col("type"))).distinct()


def merged_vertices(rows: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """The last non-empty value of each column, so an empty update never erases one."""
    return rows.groupBy(key).agg(*[F.max_by(c, F.when(F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull(), order)).alias(c) for c in columns])


def rebuilt(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges from all extracted records again; those with a blank position or without skills are skipped.

    ``extracted``: ``id, position_name, skills array<string>``. Vertices: ``id, label, name``; edges ``src, dst`` once each. Nothing of the old graph
    is kept, so a graph that is rebuilt twice is the same.
    """
    rows = extracted.withColumn("skills", F.filter(F.coalesce("skills", F.array().cast("array<string>")), lambda s: F.trim(F.coalesce(s, F.lit(""))) != ""))
    rows = rows.where((F.trim(F.coalesce("position_name", F.lit(""))) != "") & (F.size("skills") > 0)).select(F.trim("position_name").alias("position"), F.explode("skills").alias("skill"))
    edges = rows.select(X.stable_id("pos", F.col("position")).alias("src"), X.stable_id("sk", F.col("skill")).alias("dst"), "position", "skill").distinct()
    vertices = edges.select(F.col("src").alias("id"), F.lit("Position").alias("label"), F.col("position").alias("name")).unionByName(edges.select(F.col("dst").alias("id"), F.lit("Skill").alias("label"), F.col("skill").alias("name"))).distinct()
    return vertices, edges.select("src", "dst").distinct()


def exported(vertices: DataFrame, edges: DataFrame, internal: list[str]) -> tuple[DataFrame, DataFrame]:
    """Vertices with an id outside internal labels, named by their id if need be, and edges as ``source, target``."""
    v = vertices.where(F.col("id").isNotNull() & ~F.col("label").isin(internal)).select("id", F.coalesce(F.nullif("name", F.lit("")), "id").alias("name"), F.col("label").alias("type"))
    return v, edges.select(F.col("src").alias("source"), F.col("dst").alias("target")).where("source is not null and target is not null")


# versions


def snapshot_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """V1, V2: nodes of two versions (``id, name, type``) as added, removed, changed or common; the newer name counts."""
    x, y = a.select("id", F.struct("name", "type").alias("old")), b.select("id", F.struct("name", "type").alias("new"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed").otherwise("common")
    return x.join(y, "id", "full").select("id", F.coalesce("new.name", "old.name").alias("name"), state.alias("state"))


def edge_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """V1: distinct edges that only one version has."""
    return b.subtract(a).withColumn("state", F.lit("added")).unionByName(a.subtract(b).withColumn("state", F.lit("removed")))


def version_counters(nodes: DataFrame) -> DataFrame:
    """V2: added, removed and changed nodes of every version against the one before (the first: all added).

    ``nodes``: ``version, id, name, type``. Each node is compared with itself in the version before by a join on both.
    """
    versions = nodes.select("version").distinct().withColumn("next", F.lead("version").over(Window.orderBy("version")))
    old = nodes.join(small(versions, 10_000), "version").where("next is not null").select(F.col("next").alias("version"), "id", F.struct("name", "type").alias("old"))
    new = nodes.select("version", "id", F.struct("name", "type").alias("new"))
    return new.join(old, ["version", "id"], "full").groupBy("version").agg(F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("new").isNull()).alias("removed"), F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))).alias("changed"))


def type_counts(nodes: DataFrame) -> DataFrame:
    """Nodes of each version by type."""
    return nodes.groupBy("version", F.coalesce(F.nullif("type", F.lit("")), F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


def write_snapshot(nodes: DataFrame, path: str) -> None:
    """V3: replaces the partitions of the versions that ``nodes`` has and no others."""
    nodes.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("version").parquet(path)


def retained(nodes: DataFrame, since: str) -> DataFrame:
    """V3: versions from ``since`` on; the filter prunes partitions."""
    return nodes.where(F.col("version") >= since)


def edit_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """V5, V6: a position's edit as ``+skill``, ``-skill`` and ``~skill``, joined in order. Rows: ``key, skill, necessity``."""
    x, y = old.select(*key, "skill", F.col("necessity").alias("o")), new.select(*key, "skill", F.col("necessity").alias("n"))
    mark = F.when(F.col("o").isNull(), "+").when(F.col("n").isNull(), "-").when(F.col("o") != F.col("n"), "~")
    return x.join(y, [*key, "skill"], "full").withColumn("m", F.concat(mark, F.col("skill"))).groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("m")), ",").alias("diff"))


def evolved_from(new: DataFrame, gone: DataFrame, segments: int = 2) -> DataFrame:
    """New positions (``name``) that come from gone ones: a rename if one name holds the other, a split from shared bigrams.

    Names that can match share a bigram, so pairs are found by an equi-join on bigrams and not by trying all.
    """
    n = new.select(F.col("name").alias("new"), F.explode(X.bigrams(F.col("name"))).alias("g"))
    o = gone.select(F.col("name").alias("old"), F.explode(X.bigrams(F.col("name"))).alias("g"))
    pairs = n.join(o, "g").groupBy("new", "old").agg(F.count("*").alias("shared"))
    return pairs.withColumn("relation", F.when(X.contains_name(F.col("new"), F.col("old")), "rename").when(F.col("shared") >= segments, "split")).where("relation is not null")


# algorithms


#: Rounds of PageRank between two tables.
ROUNDS_A_TABLE = 2


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """G1: unweighted PageRank of a symmetric graph ``a, b``; stops when no rank moves by ``tolerance``.

    A few rounds are one plan and one written table, which has a column for each round, so that the stop is the same as round by round. A round is one join on the edges'
    key and one aggregation that combines before its shuffle. The driver sees a number for each round of a table.
    """
    work = shared_path(edges.sparkSession, "pagerank")
    e = staged(edges.select("a", "b").distinct(), f"{work}/edges")
    nodes = e.select("a").union(e.select("b")).distinct().toDF("id")
    degree = e.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    state = staged(nodes.join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree")), f"{work}/nodes")
    n, loose = state.agg(F.count("*"), F.count_if(F.col("degree") == 0)).first()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    state, done = state.withColumn("r0", F.lit(1.0 / n)), 0
    few = F.broadcast if n <= 100_000 else lambda t: t  # a row a node, which was counted
    while done < rounds:
        k = min(ROUNDS_A_TABLE if loose == 0 else 1, rounds - done)  # what loose nodes hold goes to all
        held = state
        lost = held.where("degree = 0").agg(F.sum("r0")).first()[0] if loose else 0.0
        for i in range(1, k + 1):
            sent = e.join(few(held.where("degree > 0").select(F.col("id").alias("a"), (F.col(f"r{i - 1}") / F.col("degree")).alias("part"))), "a").groupBy(F.col("b").alias("id")).agg(F.sum("part").alias("got"))
            held = held.join(few(sent), "id", "left").withColumn(f"r{i}", F.lit((1 - damping) / n + damping * lost / n) + F.coalesce("got", F.lit(0.0)) * damping).drop("got")
        held = staged(held, f"{work}/{done + k}")
        moved = held.agg(*[F.max(F.abs(F.col(f"r{i}") - F.col(f"r{i - 1}"))) for i in range(1, k + 1)]).first()
        stop = next((i for i, m in enumerate(moved, 1) if m < tolerance), None)
        state, done = held.select("id", "degree", F.col(f"r{stop or k}").alias("r0")), done + k
        if stop:
            break
    return state.select("id", F.col("r0").alias("rank"))


def modularity(pairs: DataFrame, partition: DataFrame) -> DataFrame:
    """Quality of a partition (``id, community``) of weighted pairs ``a, b, weight`` (a < b)."""
    both = adjacency(pairs)
    labelled = both.join(partition.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(partition.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    per = labelled.groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("tot"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("inside"))
    whole = both.agg(F.sum("weight").alias("m2"))
    return per.join(F.broadcast(whole), how="cross").agg(F.coalesce(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("tot") / F.col("m2"), F.lit(2))), F.lit(0.0)).alias("q"))


def clusters(partition: DataFrame, least: int = 1) -> DataFrame:
    """Members of each community with at least ``least`` of them."""
    return partition.groupBy("community").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("id")).alias("members")).where(F.col("size") >= least)


def shortest_path(edges: DataFrame, start: str, end: str, hops: int = 6) -> DataFrame:
    """The shortest path between two nodes of a symmetric graph ``a, b``, the smallest of equal length; no row: none.

    A breadth-first frontier of distinct nodes, each with its smallest path; nodes that were reached before never come back.
    """
    spark = edges.sparkSession
    work = shared_path(spark, "path")
    e = staged(edges.select("a", "b").distinct(), f"{work}/edges")
    frontier = spark.createDataFrame([(start, [start])], "id string, path array<string>")
    seen = frontier
    for i in range(hops + 1):
        hit = frontier.where(F.col("id") == end)
        if not hit.isEmpty():
            return hit.select("path")
        reached = frontier.join(e, frontier["id"] == e["a"]).join(seen.select(F.col("id").alias("b")), "b", "left_anti").groupBy(F.col("b").alias("id")).agg(F.min(F.concat("path", F.array("b"))).alias("path"))
        frontier = staged(reached, f"{work}/{i}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return frontier.where(F.lit(False)).select("path")


def reachable(edges: DataFrame) -> DataFrame:
    """``src, dst`` for all chains of prerequisites ``src -> dst`` without the start itself; cycles end.

    Chains double in length each round, until a round finds none.
    """
    work = shared_path(edges.sparkSession, "reach")
    closed = staged(edges.select("src", "dst").where("src <> dst").distinct(), f"{work}/0")
    n = closed.count()
    for i in itertools.count(1):
        longer = closed.join(closed.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst")).where("src <> dst")
        closed = staged(closed.unionByName(longer).distinct(), f"{work}/{i}")
        if (m := closed.count()) == n:
            break
        n = m
    return closed


def chain_order(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Prerequisites of each target in depth-first post-order, the target left out.

    Only the edges that a target reaches are collected with it: a skill's chain, not the graph.
    """
    reach = reachable(edges)
    mine = targets.select(F.col("skill").alias("t")).join(reach.toDF("t", "src").unionByName(targets.select(F.col("skill").alias("t"), F.col("skill").alias("src"))), "t")
    held = mine.join(edges.select("src", "dst"), "src").groupBy("t").agg(F.collect_list(F.struct("src", "dst")).alias("e"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for target, pairs in zip(b["t"], b["e"], strict=True):
                before: dict[str, list[str]] = {}
                for p in sorted(pairs, key=lambda p: (p["src"], p["dst"])):
                    before.setdefault(p["src"], []).append(p["dst"])
                out, seen, stack = [], set(), [(target, False)]
                while stack:
                    node, done = stack.pop()
                    if done:
                        out.append(node)
                    elif node not in seen:
                        seen.add(node)
                        stack.append((node, True))
                        stack += [(x, False) for x in reversed(before.get(node, [])) if x not in seen]
                rows.append((target, [x for x in out if x != target]))
            yield pd.DataFrame(rows, columns=["skill", "chain"])

    return held.mapInPandas(walk, "skill string, chain array<string>")
