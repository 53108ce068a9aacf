"""Fingerprint and vector similarity joins."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweft.functions import scores as S
from skillweft.functions import text as X
from skillweft.operators import substring
from skillweft.operators.nearest import nearest
from skillweft.sources.staging import shared_path, staged


#: Token hashes that a worker remembers, and bits that are added up at once.
KNOWN_TOKENS, TOKENS_AT_ONCE = 200_000, 1 << 16


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, bytes] = {}
    find = re.compile(X.TOKEN).findall

    def print_of(text: str) -> int:
        hashes = []
        for t in find(text):
            if (h := known.get(t)) is None:
                if len(known) >= KNOWN_TOKENS:
                    known.clear()
                h = known[t] = hashlib.md5(t.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[:8]
            hashes.append(h)
        votes = np.zeros(64, np.int64)
        for a in range(0, len(hashes), TOKENS_AT_ONCE):
            some = hashes[a : a + TOKENS_AT_ONCE]
            votes += np.unpackbits(np.frombuffer(b"".join(some), np.uint8).reshape(len(some), 8), axis=1).sum(0, dtype=np.int64)
        return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big", signed=True)

    for b in batches:  # a batch's texts stay in Arrow, one is a Python text at a time
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array((print_of(t.as_py()) for t in b.column(1)), pa.int64())], names=[b.schema.names[0], "simhash"])


def simhash(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, simhash`` of every row: 64 votes of hashed tokens; 0 without tokens. A bit is set if more than half of the tokens have it.

    A row's tokens vote inside the row, so nothing is shuffled. Texts go to Python in Arrow batches: there all 64 bits are added up at once, and a token is hashed once
    and remembered.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text")).mapInArrow(_prints, f"`{key}` {kind}, simhash long")


def near_fingerprints(prints: DataFrame, threshold: int = 3) -> DataFrame:
    """Pairs of distinct fingerprints within ``threshold`` bits, as ``a, b, distance`` (a < b).

    Fingerprints are cut into ``threshold + agree`` blocks of bits. A pair within the threshold has at least ``agree`` equal
    ones, so it meets in the key of some choice of that many: keys of 32 bits for up to 4, so that few others meet there. Equal
    fingerprints are collapsed before, so a common one is one row. ``prints``: ``simhash``.
    """
    if threshold > 15:
        raise ValueError("at most 15 bits: with narrower blocks nearly all pairs meet")
    agree = 3 if threshold <= 4 else 2 if threshold <= 8 else 1
    n = threshold + agree
    cuts = [round(64 * i / n) for i in range(n + 1)]
    masks = [((1 << z) - 1) ^ ((1 << a) - 1) for a, z in itertools.pairwise(cuts)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    chosen = [signed(sum(masks[i] for i in c)) for c in itertools.combinations(range(n), agree)]
    d = staged(prints.select("simhash").distinct(), shared_path(prints.sparkSession, "prints"))  # both sides of the join read it
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.col("simhash").bitwiseAND(F.lit(m).cast("long")).alias("v")) for i, m in enumerate(chosen)])
    keyed = d.select("simhash", F.explode(keys).alias("k")).select("simhash", "k.i", "k.v")
    a, b = keyed.withColumnRenamed("simhash", "a"), keyed.withColumnRenamed("simhash", "b")
    pairs = a.join(b, ["i", "v"]).where("a < b").withColumn("distance", X.hamming(F.col("a"), F.col("b"))).where(F.col("distance") <= threshold)
    return pairs.select("a", "b", "distance").distinct()


def near_documents(prints: DataFrame, key: str, threshold: int = 3) -> DataFrame:
    """For every row the smallest key within ``threshold`` bits, equal fingerprints included (itself: none earlier).

    Each row joins its fingerprint's smallest neighbouring key, so copies are never listed in pairs.
    """
    prints = staged(prints, shared_path(prints.sparkSession, "documents"))  # texts are read once
    first = prints.groupBy("simhash").agg(F.min(key).alias("first"))
    pairs = staged(near_fingerprints(prints, threshold), shared_path(prints.sparkSession, "pairs"))
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("simhash")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("simhash")))
    low = both.join(first, "simhash").groupBy(F.col("x").alias("simhash")).agg(F.min("first").alias("near"))
    rows = prints.join(first.join(low, "simhash", "left").select("simhash", F.least("first", "near").alias("low")), "simhash")
    return rows.select(key, F.when(F.col("low") < F.col(key), F.col("low")).alias("duplicate_of"))


def verified_pairs(pairs: DataFrame, vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """Pairs ``a, b`` without those whose vectors both exist and have a cosine below ``least``."""
    va, vb = (vectors.select(F.col("id").alias(k), F.col("vector").alias(f"v{k}")) for k in ("a", "b"))
    rows = pairs.join(va, "a", "left").join(vb, "b", "left")
    return rows.where(F.col("va").isNull() | F.col("vb").isNull() | (S.cosine(F.col("va"), F.col("vb")) >= least)).drop("va", "vb")


def aligned(names: DataFrame, vocabulary: DataFrame, vectors: DataFrame | None = None, least: float = 0.6) -> DataFrame:
    """Rule alignment of names to a vocabulary (``code, name, aliases``), exact first, then by vector.

    A name is matched if it equals a vocabulary name or alias in any case, or holds an alias of three characters or more, with or without spaces around. Equal
    names are joined by key; only names without one are looked through for terms, all at once. The first code wins.
    """
    terms = vocabulary.select("code", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("term")).select("code", F.lower("term").alias("term"))
    n = names.select("name").distinct()
    exact = n.join(terms, F.lower("name") == F.col("term")).groupBy("name").agg(F.min("code").alias("code"))
    rest = n.join(exact, "name", "left_anti")
    low, long = rest.select("name", F.lower("name").alias("text")), terms.where(F.length("term") >= 3)
    pairs = substring.holds(low, long.select(F.col("term").alias("needle"))).join(long.groupBy(F.col("term").alias("needle")).agg(F.min("code").alias("code")), "needle")
    held = low.join(pairs.groupBy("text").agg(F.min("code").alias("code")), "text").select("name", "code")
    found = exact.unionByName(held).withColumn("confidence", F.lit(1.0))
    if vectors is None:
        return found
    left = rest.join(held, "name", "left_anti").join(vectors.select(F.col("id").alias("name"), "vector"), "name").select(F.col("name").alias("id"), "vector")
    right = vocabulary.join(vectors, vocabulary["code"] == vectors["id"]).select("id", "vector")
    near = nearest(left, right, least).select(F.col("a").alias("name"), F.col("b").alias("code"), F.col("score").alias("confidence"))
    return found.unionByName(near)
