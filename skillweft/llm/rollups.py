"""Token-count rollups kept up to date by signed changes.

A change is ``doc_id, source, lang, version, sign, tokens``: +1 adds a document, -1 takes one away, 0 revises its count by
``tokens``, which may be negative. A batch is aggregated once (combined before the shuffle, so a source with most of the rows is
no group in one task) and its sums are written as one folder named by the batch. Totals are the sum over committed batches.
A folder counts as committed when its ``_SUCCESS`` file is there: a batch that is sent again is not applied again, and a batch
whose job was lost half-way leaves nothing that counts. ``compact`` adds up many small batches to one base, whose ledger names
them in ``SHARDS`` folders, so one name is looked up in one of them and the driver holds the names of uncompacted batches only. Renaming is
atomic on file systems such as HDFS; on an object store, where it is a copy, one driver at a time has to commit.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweft.llm.common import arrow_map
from skillweft.llm.tokens import CachedEncoder

KEY = ["source", "lang", "version"]
SCHEMA = "source string, lang string, version string, docs long, tokens long"
SHARDS = 256
_SHARD = f"cast(pmod(xxhash64(name), {SHARDS}) as int)"


class Rollup:
    """Totals of documents and tokens by source, language and tokenizer version below a shared folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batches")
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/batches/{name}")

    @staticmethod
    def _name(batch_id: str) -> str:
        return "b-" + quote(batch_id, safe="")

    def _folders(self, prefix: str) -> list[str]:
        if not self._fs.exists(self._root):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._root)]
        return sorted(n for n in names if n.startswith(prefix))

    def _whole(self, name: str) -> bool:
        return self._fs.exists(self._at(f"{name}/_SUCCESS"))

    def _base(self) -> str | None:
        """The newest whole base."""
        return next((n for n in reversed(self._folders("c-")) if self._whole(f"{n}/sums") and self._whole(f"{n}/batches")), None)

    def _ledger(self, base: str) -> DataFrame:
        return self.spark.read.schema("name string, shard int").parquet(f"{self.path}/batches/{base}/batches")

    def _in(self, base: str | None, names: list[str]) -> set[str]:
        """Those of ``names`` that are in the base; only their shards are read."""
        if base is None or not names:
            return set()
        wanted = self.spark.createDataFrame([(n,) for n in names], "name string")
        shards = [r[0] for r in wanted.selectExpr(_SHARD).distinct().collect()]
        return {r[0] for r in self._ledger(base).where(F.col("shard").isin(shards)).join(F.broadcast(wanted), "name").select("name").collect()}

    def committed(self) -> DataFrame:
        """``name``: folder names of committed batches."""
        base = self._base()
        new = self.spark.createDataFrame([(n,) for n in self._folders("b-") if self._whole(n)], "name string")
        return (new if base is None else new.union(self._ledger(base).select("name"))).distinct()

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; false if it was applied before. Rows with a null sign or count change nothing in that sum.

        The sums go to a folder of their own attempt, which is then renamed. Of two drivers that send the same batch, one
        rename succeeds.
        """
        name = self._name(batch_id)
        if self._whole(name) or name in self._in(self._base(), [name]):
            return False
        sums = changes.groupBy(*KEY).agg(F.coalesce(F.sum("sign"), F.lit(0)).cast("long").alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"))
        own = f"attempt-{self.spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
        sums.write.parquet(f"{self.path}/batches/{own}")
        if self._fs.exists(self._at(name)) or not self._fs.rename(self._at(own), self._at(name)) or self._fs.exists(self._at(f"{name}/{own}")):
            self._fs.delete(self._at(f"{name}/{own}"), True)
            self._fs.delete(self._at(own), True)
            return False
        return True

    def totals(self) -> DataFrame:
        """``source, lang, version, docs, tokens`` over committed batches; groups in which nothing is left don't show."""
        rows = self._rows()[0]
        if rows is None:
            return self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def _rows(self) -> tuple[DataFrame | None, list[str]]:
        """Sums of the base and of the batches that aren't in it, and the names of those."""
        base, there = self._base(), [n for n in self._folders("b-") if self._whole(n)]
        held = self._in(base, there)
        new = [n for n in there if n not in held]
        paths = [f"{self.path}/batches/{x}" for x in ([f"{base}/sums"] if base else []) + new]
        return (self.spark.read.schema(SCHEMA).parquet(*paths) if paths else None), new

    def compact(self) -> bool:
        """Add committed batches to a new base; false if there are none. A base counts once both its parts are whole.

        Batches in the base are then removed; one that isn't yet counts once all the same, as the base lists it.
        """
        rows, new = self._rows()
        base = self._base()
        if rows is None or not new:
            return False
        number = 1 + (int(base[2:]) if base else 0)
        own = f"attempt-{self.spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
        rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.path}/batches/{own}/sums")
        names = self.spark.createDataFrame([(n,) for n in new], "name string")
        if base:
            names = names.union(self._ledger(base).select("name"))
        names.withColumn("shard", F.expr(_SHARD)).repartition("shard").write.partitionBy("shard").parquet(f"{self.path}/batches/{own}/batches")
        to = f"c-{number:09d}"
        if self._fs.exists(self._at(to)) or not self._fs.rename(self._at(own), self._at(to)):
            self._fs.delete(self._at(own), True)
            return False
        for n in new:
            self._fs.delete(self._at(n), True)
        return True


def counted(documents: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, source, lang, tokens`` and the text's SHA-256 (null for a null text): the tokenizer's ids of each whole text (null: none)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = CachedEncoder.of(tokenizer)
        for b in batches:
            texts, n = b.column("text").to_pylist(), []
            for at in range(0, len(texts), 256):
                n += map(len, encoder.encode(texts[at : at + 256]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source", "lang", "digest")), pa.array(np.array(n, np.int64))], names=["doc_id", "source", "lang", "digest", "tokens"])

    return arrow_map(docs.withColumn("digest", F.unhex(F.sha2("text", 256))), count, "doc_id long, source string, lang string, digest binary, tokens long")


def changes(rows: DataFrame, version: str, sign: int, tokens: object = None) -> DataFrame:
    """Changes of one sign from ``source, lang, tokens``."""
    amount = F.col("tokens") if tokens is None else tokens
    return rows.select("source", "lang", F.lit(version).alias("version"), F.lit(sign).cast("long").alias("sign"), (amount * (-1 if sign < 0 else 1)).cast("long").alias("tokens"))
