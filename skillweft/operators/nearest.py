"""Exact nearest-neighbour and threshold joins of vectors by cosine, partitioned by pivots.

Unit vectors are ordered by cosine as they are by distance. Every base row belongs to the cell of its nearest pivot. By the triangle inequality a
query row needs only the cells that its current k-th distance reaches. Pivots come from a bounded sample and decide how much is
left out, never what is found. Memory is bounded in bytes: a task holds one chunk of a cell and a batch of queries.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillweft.sources.staging import shared_path, small, staged

#: Bytes of a cell's chunk, of all pivots together, and of the sample that they are chosen from.
CHUNK_BYTES, PIVOT_BYTES, SAMPLE_BYTES = 8 << 20, 16 << 20, 32 << 20
#: Cells at most, and queries of a chunk that one task takes.
MOST_PIVOTS, LANE_ROWS = 2048, 16_384
#: Bounds and scores that differ by rounding.
SLACK, REACH_SLACK = 1e-9, 1e-7


def _batch(types: dict[str, pa.DataType], columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[k], pa.Array) else pa.array(c, type=t) for k, t in types.items()], names=list(types))


def unit_rows(rows: DataFrame) -> DataFrame:
    """``id, size, u``: vectors scaled to length 1 as bytes of doubles; ``u`` is null for a vector of zeros.

    Null and empty vectors and those with a null or non-finite component are left out. A vector is divided by its largest component first, so none
    overflows or vanishes.
    """
    v = F.transform("vector", lambda x: x.cast("double"))
    usable = (F.size("v") > 0) & ~F.exists("v", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *lists.value_lengths().to_pylist()])
            out = []
            for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                x, top = flat[a:z], np.abs(flat[a:z]).max()
                x = x / top if top else x
                out.append((x / np.sqrt(x @ x)).tobytes() if top else None)
            yield _batch({"id": b.column("id").type, "size": pa.int32(), "u": pa.binary()}, {"id": b.column("id"), "size": np.diff(ends).astype(np.int32), "u": out})

    return rows.where("id is not null").select("id", v.alias("v")).where(usable).mapInArrow(run, f"id {kind}, size int, u binary")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def pivots_of(base: DataFrame) -> dict[int, np.ndarray]:
    """Pivots for each vector length: a few rounds of spherical k-means over a sample of ``SAMPLE_BYTES`` at most, which comes to the driver.

    About the root of the rows many, ``MOST_PIVOTS`` and ``PIVOT_BYTES`` at most.
    """
    out = {}
    for size, n in sorted((r["size"], r["count"]) for r in base.where("u is not null").groupBy("size").count().collect()):
        m = min(MOST_PIVOTS, max(1, PIVOT_BYTES // (8 * size)), math.isqrt(n) + 1)
        held = base.where((F.col("size") == size) & F.col("u").isNotNull())
        rows = held.select("u").orderBy(F.xxhash64("id")).limit(min(16 * m, max(m, SAMPLE_BYTES // (8 * size)))).collect()
        x = np.frombuffer(b"".join(bytes(r["u"]) for r in rows), np.float64).reshape(-1, size)
        p = np.unique(x[:m], axis=0)
        for _ in range(5):
            home = (x @ p.T).argmax(1)
            sums = np.zeros_like(p)
            np.add.at(sums, home, x)
            norm = np.sqrt((sums * sums).sum(1, keepdims=True))
            p = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), p)
        out[size] = p
    return out


def _by_size(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = b.column("size").to_numpy(zero_copy_only=False)
    for s in np.unique(sizes).tolist():
        yield s, b.filter(pa.array(sizes == s))


def celled(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds the ``cell`` of the nearest pivot and the distance ``r`` from it."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOT_BYTES at most for a vector length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for size, part in _by_size(b):
                d = _distances(_matrix(part.column("u"), size), shared.value[size])
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], names=[*part.schema.names, "cell", "r"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.where("u is not null").mapInArrow(run, f"{kinds}, cell int, r double")


def _places(pivots: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each cell, and the rows of each place: near cells together, ``most`` rows in one unless a single cell has more."""
    order = np.argsort((pivots @ pivots[0]) if len(pivots) else n, kind="stable")
    place, held = np.zeros(len(n), np.int64), [0]
    for c in order.tolist():
        if held[-1] and n[c] and held[-1] + n[c] > most:
            held.append(0)
        place[c] = len(held) - 1
        held[-1] += int(n[c])
    return place, np.array(held)


class Cells:
    """A base table dealt to cells, and what bounds need of each: rows, nearest and farthest distance from the pivot.

    Cells that are filled together up to ``CHUNK_BYTES`` are one place, to which a query is sent once however many of them it has to see. So copies of
    a query are as many as places at most, not as cells.
    """

    def __init__(self, base: DataFrame, work: str) -> None:
        self.pivots = pivots_of(base)
        rows = staged(celled(base, self.pivots), f"{work}/cells")
        found = rows.groupBy("size", "cell").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()  # a row a cell
        self.known = {s: {k: np.zeros(len(p)) for k in ("n", "low", "high")} for s, p in self.pivots.items()}
        for f in found:
            for k in ("n", "low", "high"):
                self.known[f["size"]][k][f["cell"]] = f[k]
        for size, k in self.known.items():
            k["place"], k["held"] = _places(self.pivots[size], k["n"], max(1, CHUNK_BYTES // (8 * size)))
        places = [(s, c, int(k["place"][c])) for s, k in self.known.items() for c in np.flatnonzero(k["n"]).tolist()]
        self.rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(places, "size int, cell int, place int")), ["size", "cell"])  # a row a cell

    def visits(self, queries: DataFrame, reach: float, bounded: bool, home: bool) -> DataFrame:
        """``queries`` with the ``cells`` that they have to see.

        With ``home`` that is the nearest cell with rows. Else it is every cell that may hold a row within ``reach``, or with ``bounded`` within the
        query's own ``reach``, less those of the nearest one's place, which was seen before.
        """
        shared = queries.sparkSession.sparkContext.broadcast((self.pivots, self.known))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, known = shared.value
            for b in batches:
                for size, part in _by_size(b):
                    if size not in pivots:
                        continue
                    x, p, k = _matrix(part.column("u"), size), pivots[size], known[size]
                    for at in range(0, len(x), block := max(1, CHUNK_BYTES // (8 * len(p)))):
                        y, rows = x[at : at + block], part.slice(at, block)
                        d = _distances(y, p)
                        near = np.where(k["n"] > 0, d, np.inf).argmin(1)
                        if home:
                            lists = [[c] for c in near.tolist()]
                        else:
                            limit = rows.column("reach").to_numpy(zero_copy_only=False) if bounded else np.full(len(y), reach)
                            least = np.maximum(d - k["high"], k["low"] - d)
                            own = d[np.arange(len(y)), near]
                            apart = _distances(p[near], p)
                            plane = np.divide(d * d - (own * own)[:, None], 2 * apart, out=np.zeros_like(d), where=apart > 1e-6)
                            seen = (np.maximum(least, plane) <= limit[:, None] + REACH_SLACK) & (k["n"] > 0)
                            if bounded:
                                seen &= k["place"][None, :] != k["place"][near][:, None]
                            else:
                                seen[np.arange(len(y)), near] = True
                            lists = [np.flatnonzero(s).tolist() for s in seen]
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lists, type=pa.list_(pa.int32()))], names=[*rows.schema.names, "cells"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
        return queries.where("u is not null").mapInArrow(run, f"{kinds}, cells array<int>").where(F.size("cells") > 0)

    def compared(self, visits: DataFrame, fn: Callable[[pa.Table, np.ndarray, pa.Table, np.ndarray], pa.RecordBatch | None], schema: str, base: DataFrame | None = None) -> DataFrame:
        """Runs ``fn(queries, their vectors, chunk, its vectors)`` wherever a query visits a place.

        A place of many rows is cut into chunks of ``CHUNK_BYTES``, and one with many visitors stands in as many lanes as they need, so a common vector
        makes more tasks and no large one. ``base``: the cells' rows with further columns, or some of them.
        """
        base = self.rows if base is None else base
        known, spark = self.known, visits.sparkSession
        of = F.broadcast(spark.createDataFrame([(s, k["place"].tolist()) for s, k in known.items()], "size int, of array<int>"))  # a row a vector length
        each = visits.join(of, "size").withColumn("place", F.explode(F.array_distinct(F.transform("cells", lambda c: F.get("of", c))))).drop("cells", "of")
        came = each.groupBy("size", "place").count().collect()  # a row a place
        plan = [(r["size"], r["place"], max(1, math.ceil(int(known[r["size"]]["held"][r["place"]]) * 8 * r["size"] / CHUNK_BYTES)), max(1, math.ceil(r["count"] / LANE_ROWS))) for r in came]
        plan = F.broadcast(spark.createDataFrame(plan, "size int, place int, chunks int, lanes int"))  # a row a place
        part = lambda salt, of: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(of).cast("long")).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        left = each.join(plan, ["size", "place"]).withColumn("lane", part("lane", "lanes")).withColumn("chunk", every("chunks")).withColumn("side", F.lit(1))
        right = base.join(plan, ["size", "place"]).withColumn("chunk", part("chunk", "chunks")).withColumn("lane", every("lanes")).withColumn("side", F.lit(0))
        keys = ["size", "place", "chunk", "lane"]
        both = left.unionByName(right, allowMissingColumns=True).drop("chunks", "lanes")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, chunk, u = None, [], None, None
            for b in batches:
                cols = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "side")])
                cuts = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
                for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == z:
                        continue
                    if (k := tuple(cols[:4, a])) != key:
                        key, held, chunk = k, [], None
                    piece = b.slice(a, z - a)
                    if cols[4, a] == 0:
                        held.append(piece)
                        continue
                    if not held:
                        continue
                    size = int(key[0])
                    if chunk is None:
                        chunk = pa.Table.from_batches(held).combine_chunks()
                        u = _matrix(chunk.column("u"), size)
                    for at in range(0, piece.num_rows, block := max(1, CHUNK_BYTES // (8 * max(size, len(u))))):
                        some = pa.Table.from_batches([piece.slice(at, block)]).combine_chunks()
                        if (out := fn(some, _matrix(some.column("u"), size), chunk, u)) is not None and out.num_rows:
                            yield out

        return both.repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(run, schema)


def _best(k: int, least: float, strict: bool, other: bool, kinds: tuple[str, str]):
    """The ``k`` best of a chunk for each query, ties by id; scores are worked out row by row, so they don't depend on who is compared together."""

    def fn(left: pa.Table, x: np.ndarray, right: pa.Table, y: np.ndarray) -> pa.RecordBatch | None:
        s = x @ y.T
        ia, ib = left.column("id").to_pylist(), right.column("id").to_pylist()
        if other:
            at = {i: j for j, i in enumerate(ib)}
            same = [(i, at[v]) for i, v in enumerate(ia) if v in at]
            if same:
                s[tuple(np.array(same).T)] = -2
        floor = np.full(len(x), least - SLACK)
        if s.shape[1] > k:
            floor = np.maximum(floor, np.partition(s, -k, axis=1)[:, -k] - SLACK)
        p, q = np.nonzero(s >= floor[:, None])
        score = np.empty(len(p))
        for a in range(0, len(p), step := max(1, CHUNK_BYTES // (8 * x.shape[1]))):
            score[a : a + step] = np.einsum("ij,ij->i", x[p[a : a + step]], y[q[a : a + step]])
        ok = (score > least) if strict else (score >= least)
        if other:
            ok &= s[p, q] > -1.5
        p, q, score = p[ok], q[ok], score[ok]
        if not len(p):
            return None
        place = np.empty(len(ib), np.int64)
        place[sorted(range(len(ib)), key=ib.__getitem__)] = np.arange(len(ib))
        order = np.lexsort((place[q], -score, p))
        p, q, score = p[order], q[order], score[order]
        kept = np.arange(len(p)) - np.searchsorted(p, p) < k
        return pa.RecordBatch.from_arrays([left.column("id").combine_chunks().take(pa.array(p[kept])), right.column("id").combine_chunks().take(pa.array(q[kept])), pa.array(score[kept])], names=["a", "b", "score"])

    return fn, f"a {kinds[0]}, b {kinds[1]}, score double"


def nearest(left: DataFrame, right: DataFrame, least: float, k: int = 1, strict: bool = False, other: bool = False) -> DataFrame:
    """For each left row (``id, vector``) the ``k`` right rows of highest cosine from ``least`` up (over it if ``strict``): ``a, b, score, rank``.

    Every left row first sees its nearest cell; its k-th best score there, or ``least``, says how far it has to look, and it is sent to those of the
    other cells that reach that far. Ties go to the smaller id; vectors of other lengths never meet, and a vector of zeros has cosine 0 with all. With
    ``other`` a row isn't its own neighbour, for a table that is compared with itself.
    """
    work = shared_path(left.sparkSession, "nearest")
    a, b = staged(unit_rows(left), f"{work}/left"), staged(unit_rows(right), f"{work}/right")
    cells = Cells(b, work)
    kinds = tuple(t.schema["id"].dataType.simpleString() for t in (left, right))
    fn, schema = _best(k, least, strict, other, kinds)
    first = staged(cells.compared(cells.visits(a, 0.0, False, True), fn, schema), f"{work}/first")
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    kth = ranked(first).where(F.col("rank") == k).select(F.col("a").alias("id"), F.col("score").alias("kth"))
    reach = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.greatest(F.coalesce("kth", F.lit(float(least))), F.lit(float(least)))))
    queries = a.join(small(staged(kth, f"{work}/kth")), "id", "left").withColumn("reach", reach).drop("kth")
    more = staged(cells.visits(queries, 0.0, True, False), f"{work}/visits")
    found = first if more.isEmpty() else first.unionByName(cells.compared(more, fn, schema))
    if least < 0 or (least == 0 and not strict):
        found = found.unionByName(_zeros(a, b, k, other))
    return ranked(found)


def _zeros(a: DataFrame, b: DataFrame, k: int, other: bool) -> DataFrame:
    """Candidates at cosine 0 through vectors of zeros: the ``k + 1`` first ids do for all."""
    out = None
    for size in sorted(r["size"] for r in b.select("size").distinct().collect()):
        left, right = a.where(F.col("size") == size), b.where(F.col("size") == size)
        all_, zero = (F.broadcast(t.select(F.col("id").alias("b")).orderBy("b").limit(k + 1)) for t in (right, right.where("u is null")))
        for some, firsts in ((left.where("u is null"), all_), (left.where("u is not null"), zero)):
            rows = some.select(F.col("id").alias("a")).crossJoin(firsts).withColumn("score", F.lit(0.0))  # k + 1 rows on one side
            rows = rows.where("a <> b") if other else rows
            out = rows if out is None else out.unionByName(rows)
    return out if out is not None else a.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("score")).limit(0)
