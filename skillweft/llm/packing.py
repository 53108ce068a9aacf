"""Packing into fixed-length sequences by cutting-stock column generation.

Documents longer than a sequence give full pieces and a remainder; the histogram of piece lengths is a cutting-stock
problem of bounded size whatever the number of documents. Its linear program is solved over patterns (which lengths share a
sequence), priced by a knapsack dynamic program. Rounded-down pattern counts and patterns for the few pieces left over are
assigned to the documents of each length class by rank; ranks and offsets come from distributed running sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillweft.llm.common import arrow_map, batch, staged
from skillweft.llm.tokens import CachedEncoder


#: Lengths above ``BUNDLE`` are rounded up to the next multiple of ``STEP``; shorter pieces stand together in bundles.
STEP, BUNDLE = 8, 32


def classes(capacity: int) -> np.ndarray:
    """Upper ends of the length classes: every length up to ``BUNDLE``, then every multiple of ``STEP`` up to ``capacity``."""
    if capacity % STEP or capacity < 2 * BUNDLE:
        raise ValueError(f"the capacity has to be a multiple of {STEP} and at least {2 * BUNDLE}")
    return np.concatenate([np.arange(1, BUNDLE + 1), np.arange(BUNDLE + STEP, capacity + 1, STEP)])


def bundles(ends: np.ndarray) -> np.ndarray:
    """How many pieces of each class stand together in the plan: as many short ones as ``BUNDLE`` holds, else one."""
    return np.maximum(1, BUNDLE // ends)


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of each capacity with any number of each size, and the last size taken (-1: none)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    order = np.argsort(sizes, kind="stable")
    s, v = sizes[order], values[order]
    fits = np.searchsorted(s, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c], last[c] = best[c - 1], -1
        if k := fits[c]:
            got = best[c - s[:k]] + v[:k]
            j = int(got.argmax())
            if got[j] > best[c]:
                best[c], last[c] = got[j], order[j]
    return best, last


def _pattern(last: np.ndarray, sizes: np.ndarray, c: int) -> np.ndarray:
    a = np.zeros(len(sizes))
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            a[last[c]] += 1
            c -= sizes[last[c]]
    return a


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and how often each is used, solving the linear program to a relative ``gap``.

    Minimises the number of sequences that hold ``demand`` pieces of each of ``sizes``. The basis begins with one size a
    pattern; prices come from its inverse, which each entering pattern updates. Prices are smoothed towards those with the
    best lower bound so far (at first, those of the total length), without which they swing. One knapsack table prices the
    best pattern with any given size, so every round has as many candidates as sizes. It stops where the sequences are
    within ``gap`` of the bound.
    """
    m = len(sizes)
    most = capacity // sizes
    basis = np.diag(most.astype(float))
    inverse, x = np.diag(1.0 / most), demand / most
    centre, bound, pull = sizes / capacity, float(demand @ sizes) / capacity, 0.9
    for _ in range(600):
        if x.sum() <= bound * (1 + gap):
            break
        prices = inverse.sum(0)
        asked = np.maximum(pull * centre + (1 - pull) * prices, 0)
        best, last = knapsack(sizes, asked, capacity)
        if (got := float(demand @ asked) / best[capacity]) > bound:
            bound, centre = got, asked / best[capacity]
        columns = []
        for i in np.argsort(-(asked + best[capacity - sizes])):
            a = _pattern(last, sizes, int(capacity - sizes[i]))
            a[i] += 1
            columns.append(a)
        columns = np.unique(np.array(columns), axis=0)
        entered = 0
        while len(columns):
            worth = columns @ inverse.sum(0)
            k = int(worth.argmax())
            if worth[k] <= 1 + 1e-9:
                break
            a = columns[k]
            columns = np.delete(columns, k, axis=0)
            d = inverse @ a
            rows = np.flatnonzero(d > 1e-9)
            if not len(rows):
                continue
            t = x[rows] / d[rows]
            r = int(rows[t.argmin()])
            step = max(0.0, x[r] / d[r])
            x = np.maximum(x - step * d, 0)
            x[r] = step
            row = inverse[r] / d[r]
            inverse = inverse - np.outer(d, row)
            inverse[r] = row
            basis[:, r] = a
            entered += 1
        if not entered:
            if pull < 1e-3:
                break
            pull = pull / 2 if pull > 0.01 else 0
    return basis, x


def plan(ends: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Integer patterns ``(bundles of each class, times)`` that hold exactly the bundles of ``counts`` pieces of each class."""
    out: list[tuple[np.ndarray, int]] = []
    sizes, left = np.maximum(ends, BUNDLE) // STEP, -(-counts // bundles(ends))
    capacity //= STEP
    on = np.flatnonzero(left)
    if not len(on):
        return out
    patterns, x = column_generation(sizes[on], left[on].astype(float), capacity)
    for j in np.argsort(-x, kind="stable"):
        a = np.zeros(len(sizes), np.int64)
        a[on] = np.rint(patterns[:, j]).astype(np.int64)
        used = a > 0
        n = min(int(x[j] + 1e-6), int((left[used] // a[used]).min())) if used.any() else 0
        if n > 0:
            out.append((a, n))
            left -= a * n
    # what rounding left: fewer bundles than the patterns hold, by first-fit decreasing over whole classes
    while left.any():
        room, a = capacity, np.zeros(len(sizes), np.int64)
        for k in np.argsort(-sizes, kind="stable"):
            if n := min(int(left[k]), room // int(sizes[k])):
                a[k] = n
                room -= n * int(sizes[k])
        times = int((left[a > 0] // a[a > 0]).min())
        out.append((a, times))
        left -= a * times
    return out


PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary, part long, class int, nth long"
_PIECE = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "doc_tokens": pa.int64(), "ids": pa.binary(), "part": pa.int64(), "class": pa.int32(), "nth": pa.int64()}


def pieces(documents: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Token ids of whole documents with the end id, cut at multiples of ``capacity``; one row a piece.

    ``part`` and ``nth`` number the pieces of each length class within each task; the table has to be staged before use,
    since they mean nothing once the rows are dealt anew.
    """
    ends = classes(capacity)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = CachedEncoder.of(tokenizer), TaskContext.get().partitionId(), np.zeros(len(ends), np.int64)
        for b in batches:
            docs = b.column("doc_id").to_pylist()
            for at in range(0, len(docs), 256):
                rows = []
                for doc, ids in zip(docs[at : at + 256], encoder.encode(b.column("text").slice(at, 256).to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        k = int(np.searchsorted(ends, len(piece)))
                        rows.append((doc, start, len(piece), len(ids), piece.astype("<u4").tobytes(), part, k, int(seen[k])))
                        seen[k] += 1
                yield batch(dict(zip(_PIECE, map(list, zip(*rows, strict=True)), strict=True)), _PIECE)

    return arrow_map(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), cut, PIECE_SCHEMA)


def assign(pieces_: DataFrame, capacity: int) -> DataFrame:
    """Sequence and offset of every staged piece: adds ``sequence_id`` and ``offset``, drops the working columns.

    Sequences are numbered from 0 without gaps and hold at most ``capacity`` ids; offsets in a sequence have no gaps.
    Only the counts of the length classes (at most ``capacity`` of them) come to the driver.
    """
    spark, ends = pieces_.sparkSession, classes(capacity)
    by_part = pieces_.groupBy("class", "part").agg(F.count("*").alias("n"))
    before = by_part.select("class", "part", (F.sum("n").over(Window.partitionBy("class").orderBy("part")) - F.col("n")).alias("before"))
    counts = np.zeros(len(ends), np.int64)
    for r in by_part.groupBy("class").agg(F.sum("n").alias("n")).collect():
        counts[r["class"]] = r["n"]
    # the ranks of each class go to the patterns in turn
    taken, base, table = np.zeros(len(ends), np.int64), 0, [[] for _ in ends]
    for a, times in plan(ends, counts, capacity):
        a = a * bundles(ends)
        for k in np.flatnonzero(a):
            table[k].append((int(taken[k]), base, int(a[k])))
        taken += a * times
        base += times
    steps = [(np.array([x[0] for x in t], np.int64), np.array([x[1] for x in t], np.int64), np.array([x[2] for x in t], np.int64)) for t in table]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, rank = b.column("class").to_numpy(), b.column("rank").to_numpy()
            sequence = np.empty(len(kind), np.int64)
            for k in np.unique(kind):
                rows = np.flatnonzero(kind == k)
                first, start, each = steps[k]
                j = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows] = start[j] + (rank[rows] - first[j]) // each[j]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence)], names=[*b.schema.names, "sequence_id"])

    ranked = pieces_.join(before, ["class", "part"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema) + ", sequence_id long"
    in_order = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank")
    return arrow_map(ranked, place, schema).withColumn("offset", F.sum("length").over(in_order) - F.col("length")).drop("class", "part", "nth", "rank")


def pack(documents: DataFrame, work: str, tokenizer: str, end_id: int, capacity: int = 2048) -> tuple[DataFrame, DataFrame]:
    """All pieces with their ids (staged), and where each stands: ``doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset``.

    Null and empty texts are documents of the end id alone. Rows with equal or null ids are documents of their own. Other
    columns are ignored. An empty table gives no piece.
    """
    held = staged(pieces(documents, tokenizer, end_id, capacity), f"{work}/pieces")
    return held, assign(held.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity)


def sequences(held: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed training sequences: ``sequence_id, length, ids`` (array of long); rows of one sequence have at most its capacity."""
    key = ["doc_id", "start", "ids_crc32"]
    ids = held.select(F.col("doc_id").alias("_d"), F.col("start").alias("_s"), F.crc32("ids").alias("_c"), F.col("ids").alias("_ids")).dropDuplicates(["_d", "_s", "_c"])
    on = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(("_d", "_s", "_c"), key, strict=True)]
    one = placed.join(ids, on).select("sequence_id", "offset", "length", F.col("_ids").alias("ids"))
    joined = one.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    hexed = F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")
    whole = F.expr("transform(sequence(0, cast(length as int) - 1), i -> cast(conv(concat(substr(h, i * 8 + 7, 2), substr(h, i * 8 + 5, 2), substr(h, i * 8 + 3, 2), substr(h, i * 8 + 1, 2)), 16, 10) as long))")
    return joined.withColumn("h", hexed).select("sequence_id", "length", whole.alias("ids"))
