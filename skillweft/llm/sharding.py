"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a tuple of shard sums. The differencing step takes the two partial partitions with the largest
spread and adds them in opposite order. It is run in every task on bounded batches of its groups, which leaves one tuple a batch,
then on these, which leaves one tuple a task, and at last on those: the driver sees as many tuples as there are tasks, never a
group, and a task holds one batch.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweft.llm.common import arrow_map, batch, small, staged


def differencing(tuples: list[tuple[int, ...]], shards: int) -> list[list[int]]:
    """For each tuple of at most ``shards`` sums, the shard of each of its places.

    Ties in spread are taken in the order given, so the result is the same every time.
    """
    heap, trees = [], []  # a tree: (left, left's order, right, right's order) or the number of a tuple
    for i, t in enumerate(tuples):
        sums = sorted(((s, k) for k, s in enumerate([*t, *[0] * (shards - len(t))])), reverse=True)
        trees.append(i)
        heapq.heappush(heap, (-(sums[0][0] - sums[-1][0]), i, tuple(s for s, _ in sums), tuple(k for _, k in sums)))
    while len(heap) > 1:
        _, a, left, left_at = heapq.heappop(heap)
        _, b, right, right_at = heapq.heappop(heap)
        both = sorted(((left[k] + right[-1 - k], k) for k in range(shards)), reverse=True)
        trees.append((a, left_at, b, right_at, [k for _, k in both]))
        node = len(trees) - 1
        sums = tuple(s for s, _ in both)
        heapq.heappush(heap, (-(sums[0] - sums[-1]), node, sums, tuple(range(shards))))
    out: list[list[int]] = [[] for _ in tuples]
    if not heap:
        return out
    # walk down: to[k] is the final shard of the node's k-th sum in its own sorted order
    _, root, _, at = heap[0]
    stack = [(root, [0] * shards)]
    for rank, k in enumerate(at):
        stack[0][1][k] = rank
    if not isinstance(trees[root], int):
        stack = [(root, list(range(shards)))]
    while stack:
        node, to = stack.pop()
        tree = trees[node]
        if isinstance(tree, int):
            out[tree] = to
            continue
        a, left_at, b, right_at, order = tree
        to_left, to_right = [0] * shards, [0] * shards
        for rank, k in enumerate(order):
            to_left[left_at[k]] = to[rank]
            to_right[right_at[-1 - k]] = to[rank]
        stack += [(a, to_left), (b, to_right)]
    return out


#: Groups that a task differences at once, some kilobyte each.
GROUPS = 50_000
_LOCAL = {"key": pa.binary(), "part": pa.int64(), "lot": pa.int64(), "place": pa.int32(), "bytes": pa.int64(), "to": pa.int32()}


def balanced(groups: DataFrame, work: str, shards: int, lot: int = GROUPS) -> DataFrame:
    """``key, shard`` for groups ``key binary, bytes long`` (one row each), sums of bytes near equal.

    One group larger than a shard's even share still stays whole; the others then fill the other shards.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums, held, n = TaskContext.get().partitionId(), [], [], 0

        def lots(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            while n and (last or n >= lot):
                table = pa.Table.from_batches(held)
                now, rest = table.slice(0, lot).sort_by([("bytes", "descending"), ("key", "ascending")]), table.slice(lot)
                held, n = rest.to_batches(), rest.num_rows
                sizes = now.column("bytes").to_numpy()
                places = np.array([p[0] for p in differencing([(int(x),) for x in sizes], shards)], np.int32)
                # a row of each group: its lot and its place there
                yield batch({"key": now.column("key").combine_chunks(), "part": np.full(len(sizes), part), "lot": np.full(len(sizes), len(sums)), "place": places, "bytes": sizes, "to": pa.nulls(len(sizes), pa.int32())}, _LOCAL)
                sums.append(tuple(np.bincount(places, sizes.astype(float), shards).astype(np.int64).tolist()))

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            yield from lots(False)
        yield from lots(True)
        # a row of each lot's place: its place in the task, and the bytes there
        rows = [(None, part, k, j, x, to[j]) for k, (s, to) in enumerate(zip(sums, differencing(sums, shards), strict=True)) for j, x in enumerate(s)]
        if rows:
            yield batch(dict(zip(_LOCAL, map(list, zip(*rows, strict=True)), strict=True)), _LOCAL)

    held = staged(arrow_map(groups, local, "key binary, part long, lot long, place int, bytes long, to int"), f"{work}/places")
    lots = held.where("to is not null")
    sums: dict[int, list[int]] = {}
    for r in lots.groupBy("part", "to").agg(F.sum("bytes").alias("n")).collect():
        sums.setdefault(r["part"], [0] * shards)[r["to"]] = r["n"]
    parts = sorted(sums)
    final = differencing([tuple(sums[p]) for p in parts], shards)
    rows = [(p, k, s) for p, to in zip(parts, final, strict=True) for k, s in enumerate(to)]
    last = held.sparkSession.createDataFrame(rows, "part long, to int, shard int")  # a row for each task and shard
    to = lots.select("part", "lot", "place", "to").join(F.broadcast(last), ["part", "to"]).select("part", "lot", "place", "shard")
    return held.where("to is null").join(small(staged(to, f"{work}/lots")), ["part", "lot", "place"]).select("key", "shard")


def shard(documents: DataFrame, work: str, shards: int = 8, hot_share: float = 0.001) -> DataFrame:
    """Shard and slot of every row: ``doc_id, size, text_crc32, shard, slot``.

    Rows with equal texts (all null ones too) are one group and stay in one shard; the size of a row is the UTF-8 bytes of
    its text (null: 0) plus 1. Slots of a shard have no gaps. Rows with null or repeated ids are rows of their own; other
    columns are ignored. Groups with at least ``hot_share`` of the rows, so ``1 / hot_share`` at most, are joined back by
    broadcast: no key of the other join has more rows than that share.
    """
    text = F.col("text").cast("string")
    digest = F.unhex(F.sha2(F.coalesce(F.concat(F.lit("t"), text), F.lit("")), 256))
    rows = staged(documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), digest.alias("key")), f"{work}/rows")
    groups = staged(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), f"{work}/groups")
    placed = staged(groups.join(balanced(groups.select("key", "bytes"), work, shards), "key"), f"{work}/shards")
    total = rows.count()
    hot = placed.where(F.col("n") >= max(2, total * hot_share)).select("key", "shard")
    cold = placed.where(F.col("n") < max(2, total * hot_share)).select("key", "shard")
    marked = rows.join(F.broadcast(hot.withColumnRenamed("shard", "_hot")), "key", "left")
    joined = marked.where("_hot is not null").withColumn("shard", F.col("_hot")).drop("_hot", "key").unionByName(marked.where("_hot is null").join(cold, "key").drop("_hot", "key"))
    return numbered(joined, work, shards)


def numbered(rows: DataFrame, work: str, shards: int) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each ``shard``: running numbers in each task plus what the tasks before it hold.

    The driver gets one count for each task and shard.
    """
    names = rows.columns
    schema = rows.schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for b in batches:
            s = b.column("shard").to_numpy()
            nth = np.empty(len(s), np.int64)
            for k in range(shards):
                at = np.flatnonzero(s == k)
                nth[at] = seen[k] + np.arange(len(at))
                seen[k] += len(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nth), pa.array(np.full(len(s), part))], names=[*b.schema.names, "_nth", "_part"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    held = staged(arrow_map(rows, count, f"{fields}, _nth long, _part long"), f"{work}/numbered")
    base, taken = [], [0] * shards
    for r in sorted(held.groupBy("_part", "shard").count().collect()):
        base.append((r["_part"], r["shard"], taken[r["shard"]]))
        taken[r["shard"]] += r["count"]
    before = held.sparkSession.createDataFrame(base, "_part long, shard int, _before long")
    return held.join(F.broadcast(before), ["_part", "shard"]).withColumn("slot", F.col("_nth") + F.col("_before")).select(*names, "slot")
