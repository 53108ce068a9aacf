"""Token ids in fixed-width bit-packed files with block offsets.

A part file: ``SWTB``, then little-endian unsigned 32-bit version, bits, ids per block; unsigned 64-bit documents, ids;
then for each document signed 64-bit id and unsigned 64-bit number of its ids (a null id is the least signed one); then an
unsigned 64-bit offset for each block and the end; then the blocks. Ids fill ``bits`` bits each, lowest bit first. Blocks
begin on whole bytes, so any range of ids is read by its blocks alone.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweft.llm.common import arrow_map, batch
from skillweft.llm.tokens import CachedEncoder

MAGIC, VERSION, BLOCK = b"SWTB", 1, 1 << 16
NULL_ID = -(1 << 63)
_HEAD = struct.Struct("<4sIIIQQ")


def width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first, filled up to a whole byte."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} doesn't fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8), bitorder="little").tobytes()


def unpacked(data: bytes, bits: int, n: int, first: int = 0) -> np.ndarray:
    """``n`` ids from the ``first`` on."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n, first * bits // 8).astype(np.uint32)
    at = (np.arange(first, first + n, dtype=np.int64)) * bits
    raw = np.frombuffer(data + bytes(8), np.uint8)
    out = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        out |= raw[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((out >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder that Spark names: Hadoop's names of S3 become Arrow's; ``abfs``, ``gs`` and ``hdfs`` are alike."""
    return pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


class PartFile:
    """Random access to a part file through a pyarrow file system."""

    def __init__(self, uri: str) -> None:
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        magic, version, self.bits, self.block, self.docs, self.ids = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{uri} is no token file of version {VERSION}")
        table = np.frombuffer(self.file.read_at(16 * self.docs, _HEAD.size), "<i8").reshape(-1, 2)
        self.doc_ids, self.counts = table[:, 0], table[:, 1]
        self.base = _HEAD.size + 16 * self.docs
        n = -(-self.ids // self.block) + 1
        self.offsets = np.frombuffer(self.file.read_at(8 * n, self.base), "<u8").astype(np.int64)
        self.base += 8 * n

    def read(self, first: int, n: int) -> np.ndarray:
        """``n`` ids from the ``first`` on; reads no block without any of them."""
        if not n:
            return np.empty(0, np.uint32)
        a, z = first // self.block, (first + n - 1) // self.block + 1
        data = self.file.read_at(int(self.offsets[z] - self.offsets[a]), int(self.base + self.offsets[a]))
        return unpacked(data, self.bits, n, first - a * self.block)


class PartWriter:
    """Collects documents and puts the file in place at once, so a task that was lost leaves no half file."""

    def __init__(self, uri: str, bits: int) -> None:
        self.uri, self.bits, self.doc_ids, self.counts, self.blocks, self.held, self.waiting = uri, bits, [], [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(NULL_ID if doc_id is None else doc_id)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        end = len(ids) if all_ else len(ids) // BLOCK * BLOCK
        self.blocks += [packed(ids[i : min(i + BLOCK, end)], self.bits) for i in range(0, end, BLOCK)]
        self.held, self.waiting = [ids[end:]], len(ids) - end

    def close(self) -> int:
        self._flush(True)
        total = sum(self.counts)
        fs, path = file_system(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(own := f"{path}.{uuid.uuid4().hex}") as f:
            f.write(_HEAD.pack(MAGIC, VERSION, self.bits, BLOCK, len(self.counts), total))
            f.write(np.array([self.doc_ids, self.counts], "<i8").T.tobytes())
            f.write(np.cumsum([0, *map(len, self.blocks)]).astype("<u8").tobytes())
            for b in self.blocks:
                f.write(b)
        fs.move(own, path)
        return total


#: Bytes of packed ids after which a task begins another part file, which bounds what it holds.
PART_BYTES = 64 << 20
_PART_SCHEMA = "part long, path string, docs long, ids long"
_PART = {"part": pa.int64(), "path": pa.string(), "docs": pa.int64(), "ids": pa.int64()}


def vocabulary_of(tokenizer: str) -> int:
    """Ids of a tokenizer file."""
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True)
    return max(known.values(), default=0) + 1


def write_ids(documents: DataFrame, out: str, tokenizer: str, vocabulary: int | None = None, end_id: int | None = None) -> DataFrame:
    """Encode every whole text and write part files below ``out`` in ascending ``doc_id`` order; returns their list.

    ``vocabulary`` is the tokenizer's own unless it is given; an id that doesn't fit it is an error. The list has ``part`` (ascending with the ids), ``path``, ``docs`` and ``ids``, one row a file. Null texts are empty;
    rows with a null id come first; rows with equal ids are ordered by their text's hash. An empty table gives no file.
    The rows are range-partitioned by id and hash, so even a repeated id is dealt over tasks.
    """
    bits = width(max(vocabulary or vocabulary_of(tokenizer), (end_id or 0) + 1))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, made, writer = CachedEncoder.of(tokenizer), TaskContext.get().partitionId(), [], None

        def close() -> None:
            made.append(((task << 24) + len(made), writer.uri, len(writer.counts), writer.close()))

        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for at in range(0, len(ids), 256):
                texts = b.column("text").slice(at, 256).to_pylist()
                for doc, tokens in zip(ids[at : at + 256], encoder.encode(texts), strict=True):
                    writer = writer or PartWriter(f"{out}/{task:06d}-{len(made):06d}.swtb", bits)
                    writer.add(doc, tokens if end_id is None else np.append(tokens, np.uint32(end_id)))
                if writer and sum(map(len, writer.blocks)) >= PART_BYTES:
                    close()
                    writer = None
        if writer:
            close()
        yield batch(dict(zip(_PART, map(list, zip(*made, strict=True)), strict=True)) if made else {k: [] for k in _PART}, _PART)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_h", F.hash("text"))
    spark = documents.sparkSession
    rows = arrow_map(docs.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text"), write, _PART_SCHEMA).collect()
    return spark.createDataFrame(sorted(rows), _PART_SCHEMA)


READ_SCHEMA = "doc_id long, start long, ids binary"


def read_ids(spark: SparkSession, parts: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it) and ``ids`` (little-endian unsigned 32-bit) from part files.

    The list of files is as short as the files are many (a row for each 64 MB at most), so its running total is made on
    the driver.
    """
    rows, total = [], 0
    for r in sorted(parts.collect()):
        rows.append((r["path"], total))
        total += r["ids"]
    if not rows:
        return spark.createDataFrame([], READ_SCHEMA)
    types = {"doc_id": pa.int64(), "start": pa.int64(), "ids": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                f, first, at = PartFile(path), 0, 0
                while at < f.docs:
                    size = np.cumsum(f.counts[at : at + 4096])
                    n = max(1, int(np.searchsorted(size, 1 << 21, "right")))  # documents of 8 MB together, one at least
                    ids, ends = f.read(first, int(size[n - 1])), size[:n]
                    starts = ends - f.counts[at : at + n]
                    yield batch({"doc_id": [None if d == NULL_ID else d for d in f.doc_ids[at : at + n].tolist()], "start": base + first + starts, "ids": [ids[a:z].tobytes() for a, z in zip(starts, ends, strict=True)]}, types)
                    first, at = first + int(ends[-1]), at + n

    return arrow_map(spark.createDataFrame(rows, "path string, base long").repartition(len(rows)), read, READ_SCHEMA)


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
