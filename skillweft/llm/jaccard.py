"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets verify them.

Equal sets are collapsed to one node first. A node has ``BANDS`` bands of ``ROWS`` minima; at Jaccard 0.8 a pair shares no band
with probability (1 - 0.8 ** 6) ** 36 < 2e-5. One law holds for all pairs: they link if they share a band and their full sets are
similar enough. Nodes that share a band are joined to candidate groups. Each group is compared within tasks in tiles of
bounded size, where links are counted and joined, so no list of pairs is ever made. A group with far more pairs than its
buckets have together (many documents have run together over few) is compared bucket by bucket instead; a pair then
counts in its first common band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweft.llm.common import WordHashes, arrow_map, batch, mixed, shingles, small, staged
from skillweft.llm.components import connected_components
from skillweft.llm.units import Links, grouped, tiles, verified

BANDS, ROWS = 36, 6
#: Nodes of a chunk, a unit compares two chunks: 256 in groups of up to 16 chunks, 1024 in larger ones, so that a small
#: group's tasks are short and a large one's nodes aren't sent out too often. N-grams of a chunk.
CHUNK, MANY, LARGE_CHUNK, CHUNK_GRAMS = 256, 16, 1024, 2_000_000
#: A node stands in up to ``BANDS`` buckets but in one group, so buckets have to have so many times fewer pairs.
FEWER = 16
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_MULTIPLY = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Band hashes, ``BANDS`` for each set (none of them empty)."""
    ends = np.cumsum([len(s) for s in sets])
    starts, x = ends - [len(s) for s in sets], (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), BANDS), np.uint64)
    v = np.empty_like(x)
    for band in range(BANDS):
        h = np.full(len(sets), band + 1, np.uint64)
        for row in range(ROWS):
            k = band * ROWS + row
            np.bitwise_xor(x, _XOR[k], out=v)
            np.multiply(v, _MULTIPLY[k], out=v)
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(v, starts).astype(np.uint64))
        out[:, band] = h
    return out


def _in_lots(sets: list[np.ndarray], grams: int = 100_000) -> np.ndarray:
    """``signatures`` of so many n-grams at a time, so that what they take is bounded."""
    ends = np.cumsum([len(s) for s in sets])
    cuts = np.searchsorted(ends // grams, np.arange(int(ends[-1]) // grams + 1))
    return np.concatenate([signatures(sets[a:z]) for a, z in zip(cuts.tolist(), [*cuts.tolist()[1:], len(sets)], strict=True) if a < z])


def node_of(grams: np.ndarray) -> int:
    """Signed 64-bit name of an n-gram set."""
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


_SIGNED = {"id": pa.int64(), "node": pa.int64(), "grams": pa.int64(), "bands": pa.list_(pa.int64())}


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            ids, texts = b.column("id").to_pylist(), b.column("text")
            rows: list[tuple] = []
            held: list[tuple[int, np.ndarray]] = []

            def sign() -> None:
                for (doc, s), bands in zip(held, signatures([s for _, s in held]) if held else [], strict=True):
                    rows.append((doc, node_of(s), len(s), bands.view(np.int64)))
                held.clear()

            size = 0
            for doc, text in zip(ids, texts, strict=True):
                s = shingles(text.as_py(), hashes, n)
                if not len(s) or doc is None:
                    rows.append((doc, None, 0, None))
                    continue
                held.append((doc, s))
                size += len(s)
                if size >= 40_000:
                    sign()
                    size = 0
            sign()
            yield batch(dict(zip(_SIGNED, map(list, zip(*rows, strict=True)), strict=True)), _SIGNED)

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections; n-grams that the same sets hold are counted together."""
    d = len(sets)
    if d == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]], float)
    grams, doc = np.concatenate(sets), np.repeat(np.arange(d), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    grams, doc = grams[order], doc[order]
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    sizes = np.diff(np.append(starts, len(grams)))
    shared = sizes > 1
    names = mixed(np.arange(1, d + 1, dtype=np.uint64))
    pattern = np.add.reduceat(names[doc], starts)[shared]
    _, first, weight = np.unique(pattern, return_index=True, return_counts=True)
    out = np.zeros((d, d))
    starts, sizes = starts[shared][first], sizes[shared][first]
    for a in range(0, len(first), 4096):
        s, n, w = starts[a : a + 4096], sizes[a : a + 4096], weight[a : a + 4096]
        at = np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())
        m = np.zeros((len(s), d))
        m[np.repeat(np.arange(len(s)), n), doc[at]] = 1
        out += (m * w[:, None]).T @ m
    return out


def _compare(n: int, numerator: int, denominator: int):
    hashes = WordHashes()

    def compare(unit: pa.Table) -> Links | None:
        seen: dict[int, tuple[int, np.ndarray]] = {}
        nodes = unit.column("node").to_pylist()
        for i, (node, text) in enumerate(zip(nodes, unit.column("text").to_pylist(), strict=True)):
            if node not in seen:  # a row that was repeated comes once
                s = shingles(text, hashes, n)
                if len(s) and node_of(s) == node:  # and another text with the same id not at all
                    seen[node] = (i, s)
        if len(seen) < 2:
            return None
        at = np.array([i for i, _ in seen.values()])
        sets = [s for _, s in seen.values()]
        size = np.array([len(s) for s in sets])
        both = overlaps(sets)
        i, j = np.nonzero(np.triu(denominator * both >= numerator * (size[:, None] + size - both), 1))
        chunk = unit.column("chunk").to_numpy()[at]
        if unit.column("low")[0] != unit.column("high")[0]:
            keep = chunk[i] != chunk[j]
            i, j = i[keep], j[keep]
        if len(i):
            used, at_used = np.unique(np.concatenate([i, j]), return_inverse=True)
            bands = _in_lots([sets[k] for k in used.tolist()]).view(np.int64)
            bucket, keep = unit.column("group")[0].as_py() if unit.column("bucket")[0].as_py() else None, np.zeros(len(i), bool)
            for a in range(0, len(i), 1 << 16):
                x, y = bands[at_used[: len(i)][a : a + (1 << 16)]], bands[at_used[len(i) :][a : a + (1 << 16)]]
                same = x == y
                keep[a : a + (1 << 16)] = same.any(1) if bucket is None else same.any(1) & (x[np.arange(len(x)), same.argmax(1)] == bucket)
            i, j = i[keep], j[keep]
        out = Links(np.array(nodes)[at], unit.column("weight").to_numpy()[at])
        out.add(i, j)
        return out

    return compare


def jaccard_join(documents: DataFrame, work: str, n: int = 5, numerator: int = 4, denominator: int = 5, by: str | None = None) -> DataFrame:
    """``doc_id, class_id, n_links`` of every row: links are other rows whose word ``n``-gram sets have a Jaccard similarity of at least ``numerator / denominator``.

    Words are those of ``common.words``; a text of fewer than ``n`` words has one gram of all of them; null texts and texts without
    words have none and link with nothing. The class is the smallest ``doc_id`` reachable by links. Rows with a null id link
    with nothing and have a null class. Rows with equal ids are rows of their own. Other columns are ignored. ``by`` forces comparison by
    ``group`` or by ``bucket``; the cheaper one of each group is the default.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    signed = staged(arrow_map(docs, _sign(n), "id long, node long, grams long, bands array<long>"), f"{work}/signed")
    classes = signed.where("node is not null").groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("weight"), F.max("grams").alias("grams"), F.first("bands").alias("bands"))
    # buckets of a band: counts combine before their shuffle, and AQE may split a key with many nodes in the join with them
    classes = staged(classes, f"{work}/classes")
    keyed = classes.select("node", F.explode("bands").alias("key"))
    full = keyed.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    buckets = staged(keyed.join(full, "key"), f"{work}/buckets")
    full = buckets.groupBy("key").agg(F.min("first").alias("first"), F.max("n").alias("n"))
    near = staged(connected_components(buckets.select(F.col("node").alias("a"), F.col("first").alias("b")), f"{work}/near"), f"{work}/candidates")
    nodes = near.join(classes.drop("bands"), "node")
    # every bucket lies in one group, which its first node names
    pairs = full.join(near.select(F.col("node").alias("first"), "component"), "first").groupBy("component").agg(F.sum(F.col("n") * F.col("n")).alias("bucket_pairs"))
    sizes = nodes.groupBy("component").agg(F.count("*").alias("n"), F.sum("grams").alias("g")).join(pairs, "component")
    nodes = staged(nodes.join(small(staged(sizes, f"{work}/sizes")), "component"), f"{work}/nodes")
    whole = F.lit(by == "group") if by else (F.col("n") <= 2 * CHUNK) | (F.col("n") * F.col("n") <= FEWER * F.col("bucket_pairs"))
    chunks = F.greatest(F.least(F.ceil(F.col("n") / CHUNK), F.lit(MANY)), F.ceil(F.col("n") / LARGE_CHUNK), F.ceil(F.col("g") / CHUNK_GRAMS))
    usual = tiles(nodes.where(whole).select("node", F.col("low").alias("rep"), "weight", F.col("component").alias("group"), F.lit(False).alias("bucket"), "n", "g"), chunks, [F.lit("component"), F.col("group")])
    dealt = nodes.where(~whole).select("node", "low", "weight", "grams").join(buckets.select("node", F.col("key").alias("group"), "n"), "node")
    weights = dealt.groupBy("group").agg(F.sum("grams").alias("g"))
    large = tiles(dealt.join(weights, "group").select("node", F.col("low").alias("rep"), "weight", "group", F.lit(True).alias("bucket"), "n", "g"), chunks, [F.lit("bucket"), F.col("group")])
    units = staged(usual.unionByName(large).drop("n", "g"), f"{work}/units")
    texts = docs.join(small(units), docs["id"] == units["rep"]).drop("id", "rep")
    found = staged(verified(texts, _compare(n, numerator, denominator)), f"{work}/links")
    return grouped(signed.select("id", "node"), found, f"{work}/groups").toDF("doc_id", "class_id", "n_links")
