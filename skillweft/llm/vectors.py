"""Embedding near-duplicates by a subspace pigeonhole join.

Vectors of length 1 are rotated and split into ``BLOCKS`` blocks. If two of them are within a squared distance of 2 - 2 cos, some
block has at most its proportional share of it, so it is enough to find, in each block, the pairs within that budget. A range join
does so on a grid over the block's first coordinates: a vector is at home in its cell and a guest in the later cells that
the budget reaches. The cells are compared in tiles of two bounded chunks that hold the block's coordinates only, as whole
steps of a byte; rounding widens the budget, so no pair is lost. Vectors are fetched for rows with a candidate, which are verified
exactly; a pair counts in the block where it is closest.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweft.llm.common import arrow_map, batch, runs, small, staged
from skillweft.llm.units import Links, grouped, verified

BLOCKS = 4
#: Rows of a chunk at most, and bytes of its vectors as doubles; a unit compares two.
CHUNK, CHUNK_BYTES = 16384, 32 << 20
TILE = 512
#: Rows of each side that are verified at once, and bytes of the vectors of pairs that are fetched one by one.
BLOCK_ROWS, LOT_BYTES = 1024, 8 << 20
#: Byte steps for a distance of 1: coordinates of a block lie within 1.
STEPS = 127


def rotation(dim: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int) -> list[slice]:
    cuts = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
    return [slice(a, z) for a, z in itertools.pairwise(cuts.tolist())]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows over a power of two near their largest component, which is exact: no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def rotated(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(x.shape[1])


def budgets(dim: int, cosine: float) -> np.ndarray:
    """Squared distance that each block may have: its share by dimension, and room for rounding."""
    return np.array([(2 - 2 * cosine) * (s.stop - s.start) / dim for s in blocks(dim)]) + 1e-6


def coordinates(rows: int) -> int:
    """Grid coordinates of a block: with each, cells hold about half the pairs and rows have three times the guests."""
    return min(4, 1 + max(0, round(np.log(max(rows, 1) / 100_000) / np.log(8))))


_CELL = {"node": pa.int64(), "dim": pa.int32(), "block": pa.int32(), "cell": pa.int64(), "home": pa.bool_(), "at": pa.binary()}


def _cell(c: np.ndarray) -> np.ndarray:
    """Numbers of grid cells in the order of their coordinates."""
    out = np.zeros(len(c), np.int64)
    for k in range(c.shape[1]):
        out = out * 4096 + (c[:, k] + 2048)
    return out


def _cells(kind: str, cosine: float, grid: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                raw = part.column("vector").to_pylist()
                dims = np.array([len(v) for v in raw])
                for dim in np.unique(dims).tolist():
                    rows = np.flatnonzero(dims == dim)
                    z = rotated(np.array([raw[i] for i in rows], kind).astype(float))
                    node = part.column("node").to_numpy()[rows]
                    for k, (s, budget) in enumerate(zip(blocks(dim), budgets(dim, cosine), strict=True)):
                        reach = float(np.sqrt(budget)) + 1e-6
                        steps = np.round(z[:, s] * STEPS).astype(np.int8)
                        data = [v.tobytes() for v in steps]
                        c = np.floor(z[:, s][:, :grid] / reach).astype(np.int64)
                        for move in itertools.product((-1, 0, 1), repeat=c.shape[1]):
                            if move < (0,) * len(move):
                                continue  # guests go to later cells only, so a pair meets once
                            yield batch({"node": node, "dim": np.full(len(rows), dim, np.int32), "block": np.full(len(rows), k, np.int32), "cell": _cell(c + np.array(move)), "home": np.full(len(rows), not any(move)), "at": data}, _CELL)

    return run


def boxed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of rows by their widest coordinate, and the least and largest coordinates of each ``TILE`` of them."""
    order = np.argsort(x[:, x.astype(np.float32).var(0).argmax()], kind="stable")
    starts = range(0, len(x), TILE)
    return order, np.array([x[order[i : i + TILE]].min(0) for i in starts], np.float32), np.array([x[order[i : i + TILE]].max(0) for i in starts], np.float32)


def near_rows(first: np.ndarray, second: np.ndarray, budget: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two chunks have a row of the other within the budget, up to the rounding to steps.

    Tiles whose boxes are further apart than the budget are left out.
    """
    reach = (np.sqrt(budget) + np.sqrt(first.shape[1]) / STEPS) ** 2 * STEPS * STEPS * (1 + 1e-5) + 1
    order_a, low_a, high_a = boxed(first)
    order_b, low_b, high_b = (order_a, low_a, high_a) if same else boxed(second)
    a, b = first[order_a].astype(np.float32), second[order_b].astype(np.float32)
    # one product gives the squared distance: |a|^2 + |b|^2 - 2 a b
    a = np.hstack([-2 * a, (a * a).sum(1, keepdims=True), np.ones((len(a), 1), np.float32)])
    b = np.hstack([b, np.ones((len(b), 1), np.float32), (b * b).sum(1, keepdims=True)])
    hit_a, hit_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    buffer = np.empty(TILE * TILE, np.float32)  # tiles of this size stay in a core's cache
    for i in range(0, len(a), TILE):
        k = i // TILE
        gap = np.maximum(np.maximum(low_b - high_a[k], low_a[k] - high_b), 0)
        for j in (np.flatnonzero((gap * gap).sum(1) <= reach) * TILE).tolist():
            if same and j < i:
                continue
            x, y = a[i : i + TILE], b[j : j + TILE]
            d = np.matmul(x, y.T, out=buffer[: len(x) * len(y)].reshape(len(x), len(y)))
            if same and i == j:
                np.fill_diagonal(d, np.inf)  # not with itself
            rows = np.flatnonzero(d.min(1) <= reach)
            if len(rows):
                hit_a[i + rows] = True
                hit_b[j : j + TILE] |= (d[rows] <= reach).any(0)
    if same:
        hit_a |= hit_b
        hit_b = hit_a
    out_a, out_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    out_a[order_a], out_b[order_b] = hit_a, hit_b
    return out_a, out_b


def _candidates(cosine: float):
    """``node, unit`` and its keys for rows that have a candidate in their unit."""
    types = {"node": pa.int64(), "unit": pa.int64(), "block": pa.int32(), "side": pa.int32(), "low": pa.int32(), "high": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches, "unit"):
            dim, block, low, high = (unit.column(c)[0].as_py() for c in ("dim", "block", "low", "high"))
            side, at = unit.column("side").to_numpy(), unit.column("at").combine_chunks()
            x = np.frombuffer(b"".join(at.to_pylist()), np.int8).reshape(len(side), -1)
            one, two = np.flatnonzero(side == low), np.flatnonzero(side == high)
            if not len(one) or not len(two):
                continue
            a, b = near_rows(x[one], x[two], float(budgets(dim, cosine)[block]), low == high)
            hit = one[a] if low == high else np.concatenate([one[a], two[b]])
            if len(hit):
                yield batch({"node": unit.column("node").to_numpy()[hit], "unit": np.full(len(hit), unit.column("unit")[0].as_py()), "block": np.full(len(hit), block, np.int32), "side": side[hit], "low": np.full(len(hit), low, np.int32), "high": np.full(len(hit), high, np.int32)}, types)

    return run


def _compare(kind: str, cosine: float):
    """Verifies a unit's pairs block by block: a few by their own vectors, many by products of matrices, so work arrays are bounded in bytes."""

    def compare(unit: pa.Table) -> Links | None:
        table = unit.sort_by([("side", "ascending"), ("node", "ascending")])
        low, high, block = (table.column(c)[0].as_py() for c in ("low", "high", "block"))
        side = table.column("side").to_numpy()
        values = table.column("vector").combine_chunks()
        x = scaled(values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(float))
        norm, z = np.linalg.norm(x, axis=1), rotated(x)
        budget, parts = budgets(x.shape[1], cosine)[block], blocks(x.shape[1])
        sizes = [s.stop - s.start for s in parts]
        squares = [(z[:, s] ** 2).sum(1) for s in parts]
        y = z[:, parts[block]].astype(np.float32)
        square = (y.astype(float) ** 2).sum(1).astype(np.float32)
        out = Links(table.column("node").to_numpy(), table.column("weight").to_numpy())
        lot = max(1, LOT_BYTES // (8 * x.shape[1]))

        def linked(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            """Pairs by their own vectors, ``lot`` at once."""
            return np.concatenate([np.einsum("ij,ij->i", x[p[c : c + lot]], x[q[c : c + lot]]) / (norm[p[c : c + lot]] * norm[q[c : c + lot]]) >= cosine for c in range(0, len(p), lot)])

        end, start = (len(y), 0) if low == high else (int((side == low).sum()),) * 2
        for a in range(0, end, BLOCK_ROWS):
            to_a = min(a + BLOCK_ROWS, end)
            for b in range(a if low == high else start, len(y), BLOCK_ROWS):
                to = min(b + BLOCK_ROWS, len(y))
                close = square[a:to_a, None] + square[b:to] - 2 * (y[a:to_a] @ y[b:to].T) <= np.float32(budget + 1e-5)
                if low == high and a == b:
                    close = np.triu(close, 1)
                i, j = np.nonzero(close)
                if not len(i):
                    continue
                if len(i) > lot:
                    s = (x[a:to_a] @ x[b:to].T) / (norm[a:to_a, None] * norm[b:to])
                    i, j = np.nonzero(close & (s >= cosine - 1e-9))
                    edge = np.flatnonzero(s[i, j] < cosine + 1e-9)  # products of matrices round in other ways
                    keep = np.ones(len(i), bool)
                    if len(edge):
                        keep[edge] = linked(i[edge] + a, j[edge] + b)
                else:
                    keep = linked(i + a, j + b)
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                # the block of least distance, only for pairs that are links
                if len(i) > lot:
                    share = np.stack([((q[a:to_a, None] + q[b:to] - 2 * (z[a:to_a, s] @ z[b:to, s].T)) / n)[i, j] for s, n, q in zip(parts, sizes, squares, strict=True)])
                else:
                    d = (z[i + a] - z[j + b]) ** 2
                    share = np.stack([d[:, s].sum(1) / n for s, n in zip(parts, sizes, strict=True)])
                mine = np.round(share * 1e9).argmin(0) == block
                out.add(i[mine] + a, j[mine] + b)
        return out

    return compare


def units(cells: DataFrame, counts: DataFrame, chunk: int) -> DataFrame:
    """Rows of cells dealt to units of two chunks of about ``chunk`` rows, and fewer of long vectors: adds ``unit``, ``side`` (the row's chunk), ``low``, ``high``.

    The chunks of a cell are those of its home rows, from 0 on, and then those of its guests. Home chunks meet each
    other and themselves, and the guests' chunks: a home row stands in as many units as there are chunks, a guest in as
    many as there are home chunks. ``counts``: ``dim, block, cell, homes, guests``.
    """
    most = F.least(F.lit(chunk), F.greatest(F.lit(1), F.floor(F.lit(CHUNK_BYTES) / (8 * F.col("dim")))))
    sizes = counts.where("homes > 0").select("dim", "block", "cell", F.ceil(F.col("homes") / most).cast("int").alias("h"), F.ceil(F.col("guests") / most).cast("int").alias("g"))
    mine = F.pmod(F.xxhash64("node", F.lit("chunk")), F.when(F.col("home"), F.col("h")).otherwise(F.col("g")).cast("long")).cast("int")
    side = F.when(F.col("home"), mine).otherwise(F.col("h") + mine)
    others = F.sequence(F.lit(0), F.when(F.col("home"), F.col("h") + F.col("g")).otherwise(F.col("h")) - 1)
    dealt = cells.join(small(sizes), ["dim", "block", "cell"]).withColumn("side", side).withColumn("_o", F.explode(others))
    dealt = dealt.withColumn("low", F.least("side", "_o")).withColumn("high", F.greatest("side", "_o"))
    return dealt.withColumn("unit", F.xxhash64("dim", "block", "cell", "low", "high")).select("node", "dim", "block", "at", "side", "low", "high", "unit")


def near_vectors(embeddings: DataFrame, work: str, cosine: float = 0.95, grid: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding`` (array of float or double).

    Rows link at a cosine of at least ``cosine`` in double precision. Null or zero vectors and those with null or non-finite
    components link with nothing, nor do vectors of different lengths; a null id has a null component, no links and isn't kept.
    Rows with equal ids are rows of their own. Equal vectors are compared once. Other columns are ignored. ``grid`` sets how
    many coordinates cells have, by default by the number of rows; the links are the same with any.
    """
    element = embeddings.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding") if element in ("float", "double") else F.col("embedding").cast("array<double>")
    kind = "<f4" if element == "float" else "<f8"
    large = F.array_max(F.transform(v, lambda e: F.abs(e.cast("double"))))  # NaN is the largest
    fit = v.isNotNull() & ~F.exists(v, lambda e: e.isNull()) & (large > 0) & (large < float("inf"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.when(fit & F.col("vec_id").isNotNull(), v).alias("vector"))
    rows = rows.withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    members = staged(rows.select("id", "node"), f"{work}/members")
    classes = staged(rows.where("node is not null").groupBy("node").agg(F.count("*").alias("weight"), F.first("vector").alias("vector")), f"{work}/classes")
    grid = grid or coordinates(classes.count())
    cells = staged(arrow_map(classes.select("node", "vector"), _cells(kind, cosine, grid), "node long, dim int, block int, cell long, home boolean, at binary"), f"{work}/cells")
    counts = staged(cells.groupBy("dim", "block", "cell").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests")), f"{work}/counts")
    dealt = units(cells, counts, chunk).repartition("unit").sortWithinPartitions("unit")
    near = staged(arrow_map(dealt, _candidates(cosine), "node long, unit long, block int, side int, low int, high int"), f"{work}/near")
    fetched = near.join(classes, "node")
    found = staged(verified(fetched, _compare(kind, cosine)), f"{work}/links")
    return grouped(members, found, f"{work}/groups").select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
