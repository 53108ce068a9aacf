"""Comparison units: bounded groups of rows in which pairs are verified, counted and joined, never listed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweft.llm.common import arrow_map, batch, runs, small, staged
from skillweft.llm.components import connected_components

LINK_SCHEMA = "node long, links long, other long"
_LINK = {"node": pa.int64(), "links": pa.int64(), "other": pa.int64()}


def tiles(rows: DataFrame, chunks: Column, unit: list[Column]) -> DataFrame:
    """Rows of groups of any size dealt to units of two of the group's chunks: adds ``unit``, ``chunk``, ``low`` and ``high``.

    Each row stands in as many units as its group has chunks, and each pair of rows meets in exactly one unit.
    """
    return (
        rows.withColumn("_n", F.greatest(F.lit(1), chunks).cast("int"))
        .withColumn("chunk", F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("_n").cast("long")).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("low", F.least("chunk", "_o"))
        .withColumn("high", F.greatest("chunk", "_o"))
        .withColumn("unit", F.xxhash64(*unit, "low", "high"))
        .drop("_n", "_o")
    )


class Links:
    """Link counts and a spanning forest of one unit, filled block by block."""

    def __init__(self, nodes: np.ndarray, weights: np.ndarray) -> None:
        self.nodes, self.weights, self.links, self.parent = nodes, weights, np.zeros(len(nodes), np.int64), np.arange(len(nodes))

    def _root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Links between rows i and j, each given once."""
        if not len(i):
            return
        np.add.at(self.links, i, self.weights[j])
        np.add.at(self.links, j, self.weights[i])
        while len(apart := np.flatnonzero(self.parent[i] != self.parent[j])):
            i, j = i[apart], j[apart]
            for a, b in zip(i[:4096].tolist(), j[:4096].tolist(), strict=True):
                a, b = self._root(a), self._root(b)
                if a != b:
                    self.parent[max(a, b)] = min(a, b)
            while (up := self.parent[self.parent]).tobytes() != self.parent.tobytes():
                self.parent = up

    def batch(self) -> pa.RecordBatch | None:
        """A row for each linked node: its links here, and a node that it is connected with (itself: none)."""
        at = np.flatnonzero(self.links)
        if not len(at):
            return None
        return batch({"node": self.nodes[at], "links": self.links[at], "other": self.nodes[[self._root(i) for i in at.tolist()]]}, _LINK)


def verified(rows: DataFrame, compare: Callable[[pa.Table], Links | None]) -> DataFrame:
    """Run ``compare`` on every unit; many units share a task, and a unit is never split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for unit in runs(batches, "unit"):
            if unit.num_rows > 1 and (links := compare(unit)) is not None and (b := links.batch()) is not None:
                held.append(b)
            if len(held) >= 500:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return arrow_map(rows.repartition("unit").sortWithinPartitions("unit"), run, LINK_SCHEMA)


def grouped(members: DataFrame, found: DataFrame, work: str) -> DataFrame:
    """``id, component, n_links`` of every row of ``members`` (``id, node``; node null: links with nothing).

    ``members`` and ``found`` (of ``verified``) are staged. Rows of one node are copies: linked with each other, and with all
    rows of every linked node. The component is its smallest id. Only nodes with copies or links are joined back to the rows;
    they are broadcast if they are few, and else AQE splits the rows of a node with many copies.
    """
    nodes = members.where("node is not null and id is not null").groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")), work)
    known = nodes.join(links, "node", "left").join(labels, "node", "left").where("n > 1 or links > 0")
    known = staged(known.select("node", "low", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), f"{work}/known")
    lowest = small(known.groupBy("component").agg(F.min("low").alias("lowest")))
    ends = known.join(lowest, "component").select("node", "lowest", "n_links")
    ends = small(staged(ends, f"{work}/ends"))
    return members.join(ends, "node", "left").select(
        "id",
        F.when(F.col("id").isNotNull(), F.coalesce("lowest", "id")).alias("component"),
        F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )
