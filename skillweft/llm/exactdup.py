"""Exact deduplication of a stream of texts.

Keyed state without expiry, in RocksDB on the executors' disks and in the query's checkpoint, keeps for every different text its digest, the
identifier of the row that stays, the number of its rows and where its bytes lie. A digest that is already known is a hit: the
bytes of both texts are read and compared, and a text that differs is one of its own. So results don't depend on digests.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skillweft.llm.common import arrow_map, batch, small, workspace
from skillweft.llm.idfile import file_system

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Settings of the state stores, of which there are as many as shuffle partitions: memory that those of an executor share, nothing allocated ahead on disk, and
#: changes uploaded instead of whole files.
STORE = {"boundedMemoryUsage": "true", "maxMemoryUsageMB": "256", "allowFAllocate": "false", "changelogCheckpointing.enabled": "true"}

#: Bytes and number of texts within which a task combines equal ones before it forgets them.
WINDOW_BYTES, WINDOW_TEXTS = 32 << 20, 50_000

#: Texts a state key (a prefix of digests) should hold in the end; a value is rewritten when one of its texts comes again.
PER_KEY = 16

_ENTRY = {"bucket": pa.int64(), "digest": pa.binary(), "top": pa.int64(), "n": pa.int64(), "at": pa.string()}
_ENTRY_SCHEMA = "bucket long, digest binary, top long, n long, at string"
_STATE = "texts array<struct<digest: binary, top: bigint, n: bigint, at: string>>"
GROUPS = "digest binary, class int, keep_id long, n long, at string, clash boolean"


def digest_of(data: bytes, size: int = 32) -> bytes:
    """The first ``size`` bytes of a text's SHA-256."""
    return hashlib.sha256(data).digest()[:size]


class ContentStore:
    """Texts by their locator ``file:offset:length`` below a shared folder; each text is a frame of its own."""

    def __init__(self, folder: str) -> None:
        self.fs, self.path = file_system(folder)
        self.open = functools.lru_cache(32)(self._open)
        self.unpack = zstandard.ZstdDecompressor()

    def _open(self, name: str):
        return self.fs.open_input_file(f"{self.path}/{name}")

    def read(self, locator: str) -> bytes:
        name, offset, length = locator.split(":")
        return self.unpack.decompress(self.open(name).read_at(int(length), int(offset)))


class ContentWriter:
    """Writes the texts of one task attempt; the name is its own, so a lost attempt is never referred to."""

    def __init__(self, folder: str) -> None:
        self.fs, self.path = file_system(folder)
        self.name, self.at, self.pack, self.file = uuid.uuid4().hex, 0, zstandard.ZstdCompressor(1), None

    def add(self, data: bytes) -> str:
        if self.file is None:
            self.fs.create_dir(self.path, recursive=True)
            self.file = self.fs.open_output_stream(f"{self.path}/{self.name}")
        frame = self.pack.compress(data)
        self.file.write(frame)
        self.at += len(frame)
        return f"{self.name}:{self.at - len(frame)}:{len(frame)}"

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def entries(docs: DataFrame, store: str, bits: int, size: int = 32) -> DataFrame:
    """One row for the equal texts that a task sees close together: bucket, digest, largest id, rows, locator; null texts are empty.

    Texts are combined by their bytes, not by digests, and every text that is sent on is in the store. A text that makes up a third of all
    rows leaves a task once for every 32 MB that it reads. ``docs`` may be a stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        writer, waiting = ContentWriter(store), 0

        def out() -> pa.RecordBatch:
            rows = [(int.from_bytes(d[:8].ljust(8, b"\0"), "big") >> (64 - bits) if bits else 0, d, top, n, writer.add(t)) for t, (top, n) in held.items() for d in (digest_of(t, size),)]
            held.clear()
            return batch(dict(zip(_ENTRY, map(list, zip(*rows, strict=True)), strict=True)), _ENTRY)

        for b in batches:
            for doc, data in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                data = data or b""
                if (seen := held.get(data)) is None:
                    held[data] = [doc, 1]
                    waiting += len(data)
                else:
                    seen[1] += 1
                    if doc is not None and (seen[0] is None or doc > seen[0]):
                        seen[0] = doc
                if waiting >= WINDOW_BYTES or len(held) >= WINDOW_TEXTS:
                    yield out()
                    waiting = 0
        if held:
            yield out()
        writer.close()

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, _ENTRY_SCHEMA)


class Known(StatefulProcessor):
    """The texts whose digests begin alike; state has no expiry."""

    def __init__(self, store: str) -> None:
        self.folder = store

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state, self.store = handle.getValueState("texts", _STATE), ContentStore(self.folder)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        held = self.state.get()
        known: dict[bytes, list[list]] = {}
        for t in held[0] if held else []:
            known.setdefault(bytes(t[0]), []).append([t[1], t[2], t[3]])
        changed: dict[bytes, set[int]] = {}
        anchors: dict[str, bytes] = {}  # bytes of the known text that was compared last
        for r in rows:
            digest = bytes(r["digest"])
            same = known.setdefault(digest, [])
            found = None
            if same:
                data = self.store.read(r["at"])
                for i, (_, _, at) in enumerate(same):
                    if at not in anchors:
                        anchors = {at: self.store.read(at)}
                    if anchors[at] == data:
                        found = i
                        break
            if found is None:
                same.append([r["top"], r["n"], r["at"]])
                found = len(same) - 1
            else:
                top, n, at = same[found]
                ids = [i for i in (top, r["top"]) if i is not None]
                same[found] = [max(ids) if ids else None, n + r["n"], at]
            changed.setdefault(digest, set()).add(found)
        self.state.update(([(d, top, n, at) for d, same in known.items() for top, n, at in same],))
        for digest, which in changed.items():
            same = known[digest]
            for i in range(len(same)) if len(same) > 1 else which:
                top, n, at = same[i]
                if n > 1 or len(same) > 1:
                    yield Row(digest=digest, **{"class": i}, keep_id=top, n=n, at=at, clash=len(same) > 1)

    def close(self) -> None:
        pass


def key_bits(rows: int) -> int:
    """Bits of the digest that make a state key when ``rows`` texts are expected."""
    return max(0, math.ceil(math.log2(max(1, rows) / PER_KEY)))


def _layout(work: str, bits: int, size: int) -> tuple[int, int]:
    """Key bits and digest size of the first start in ``work``: state is found again by them only."""
    fs, path = file_system(work)
    if fs.get_file_info(f"{path}/layout").type == pyarrow.fs.FileType.NotFound:
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/layout") as f:
            f.write(f"{bits} {size}".encode())
    with fs.open_input_file(f"{path}/layout") as f:
        bits, size = map(int, f.read().split())
    return bits, size


def dedup_stream(stream: DataFrame, work: str, expected: int, size: int = 32):
    """Starts the deduplication of a stream of ``doc_id, text`` and returns its query, which ends when all that is there was read.

    It goes on from ``work`` when it is started again there, with what has come since. A batch's changed groups are written over those of
    an earlier attempt at it, so each counts once. ``groups`` reads the outcome. The first start decides the state's keys from the texts ``expected`` in the end (more or
    fewer may come) and the digests' ``size``.
    """
    spark = stream.sparkSession
    bits, size = _layout(work, key_bits(expected), size)
    rows = entries(stream, f"{work}/texts", bits, size).groupBy("bucket").transformWithState(Known(f"{work}/texts"), GROUPS, "update", "none")

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{work}/groups/batch={batch_id}")

    own = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, **{f"spark.sql.streaming.stateStore.rocksdb.{k}": v for k, v in STORE.items()}}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        return rows.writeStream.outputMode("update").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    finally:  # the query has its own copy of the settings
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def groups(spark: SparkSession, work: str) -> DataFrame:
    """Texts of two rows or more after all batches so far: ``digest, class, keep_id, n, at, clash``; ``clash``: other texts have the digest, too.

    Ids and counts only grow, so the last state of a text is the largest. A text with a clash is listed whatever its rows.
    """
    rows = spark.read.schema(GROUPS).option("recursiveFileLookup", "true").parquet(f"{work}/groups")
    return rows.groupBy("digest", "class").agg(F.max("keep_id").alias("keep_id"), F.max("n").alias("n"), F.max("at").alias("at"), F.max("clash").alias("clash"))


def labelled(docs: DataFrame, found: DataFrame, work: str, size: int = 32) -> DataFrame:
    """``docs`` with ``keep_id, group_size, kept, text_sha256``: every row, dropped ones too.

    The row with the largest ``doc_id`` of equal texts stays. Null ids come after all others: a group of nulls alone keeps null, and its
    rows are all kept, as are rows that repeat the id that stays. A null text is empty. ``found`` (of ``groups``) has a row for each text with copies; it is broadcast if
    it is counted to be small, and else a common text's rows can be split. Where digests clash, rows meet by their bytes.
    """
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumns({"text_sha256": sha, "digest": F.substring(F.unhex(sha), 1, size)})
    clashing = found.where("clash")
    plain = rows.drop("text")
    first = small(found.where("not clash").select("digest", "keep_id", "n"))
    if clashing.isEmpty():
        out = plain.join(first, "digest", "left")
    else:
        texts = _with_text(clashing, f"{work}/texts")
        these = F.broadcast(texts.select("digest").distinct()) if texts.count() <= 100_000 else texts.select("digest").distinct()
        apart = rows.join(these, "digest", "left_semi").withColumn("data", F.coalesce(F.col("text"), F.lit("")).cast("binary")).drop("text").join(texts, ["digest", "data"], "left").drop("data")
        out = plain.join(these, "digest", "left_anti").join(first, "digest", "left").unionByName(apart)
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def _with_text(found: DataFrame, folder: str) -> DataFrame:
    types = {"digest": pa.binary(), "data": pa.binary(), "keep_id": pa.int64(), "n": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = ContentStore(folder)
        for b in batches:
            rows = list(zip(*(b.column(k).to_pylist() for k in ("digest", "keep_id", "n", "at")), strict=True))
            for part in itertools.batched(rows, 64):
                yield batch({"digest": [r[0] for r in part], "data": [store.read(r[3]) for r in part], "keep_id": [r[1] for r in part], "n": [r[2] for r in part]}, types)

    return arrow_map(found.select("digest", "keep_id", "n", "at"), run, "digest binary, data binary, keep_id long, n long")


def dedup_folder(spark: SparkSession, path: str, work: str, batch_bytes: str | None = None, size: int = 32) -> DataFrame:
    """Streams the Parquet table at ``path`` through ``dedup_stream`` and returns its labelled rows.

    ``batch_bytes``: input of a micro-batch at most (a file at least); all that is there by default. The table's number of rows, from its files' footers, sizes the
    state's keys. Without rows there are none.
    """
    docs = spark.read.parquet(path)
    if not (n := docs.count()):
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lit("").alias("text_sha256")).limit(0)
    reader = spark.readStream.schema(docs.schema)
    reader = reader.option("maxBytesPerTrigger", batch_bytes) if batch_bytes else reader
    path = path.rstrip("/")
    query = dedup_stream(reader.parquet(f"{path[:-1]}[{path[-1]}]"), work, n, size)  # a stream takes a single file only by a pattern
    query.awaitTermination()
    return labelled(docs, groups(spark, work), work, size)


def exact_dedup(spark: SparkSession, path: str, name: str = "exactdup") -> DataFrame:
    """``dedup_folder`` in a folder of its own."""
    return dedup_folder(spark, path, workspace(spark, name))
