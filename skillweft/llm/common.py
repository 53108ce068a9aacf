"""Shared pieces: the shared work folder, staged tables, Arrow mapping, words and shingles."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only after its rows were counted and are no more than this.
BROADCAST_ROWS = 200_000

#: Python workers get no Arrow batch above this many bytes (rows are never split).
BATCH_BYTES = 4 << 20


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``.

    Only where that setting is missing on one machine (tests) a temporary folder is made, once for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skillweft-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage ends here and lost executors lose nothing."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if a count proves that it has at most ``limit`` rows; otherwise leave the join to AQE."""
    return F.broadcast(df) if df.count() <= limit else df


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, so that very long texts don't pile up in one batch."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1))) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def batch(columns: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    """A record batch of the given columns in the order of ``types``."""
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[k], pa.Array) else pa.array(c, type=t) for k, t in types.items()], names=list(types))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each run of equal ``key`` as a table; input is sorted by it within the partition."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, z in itertools.pairwise([0, *cuts.tolist(), len(k)]):
            held.append(b.slice(a, z - a))
            if z < len(k):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


# words and shingles

#: A-Z become lower case; ASCII characters that are neither letters nor digits separate words. All other characters belong to words.
_WORD_BYTES = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b > 127 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a whole text as UTF-8; none for null."""
    return folded(text).split()


def folded(text: str | None) -> bytes:
    """A whole text as UTF-8 with its words in lower case and spaces between them."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES) if text else b""


class WordHashes(dict):
    """64-bit hash of a word, remembered up to a bound."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: WordHashes, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word ``n``-grams of a whole text; of all its words if there are fewer than ``n``."""
    ws = words(text)
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    n = min(n, len(ws))
    out = np.zeros(len(ws) - n + 1, np.uint64)
    for j in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(ws) - n + 1 + j])
    return np.unique(out)
