"""A corpus pipeline: language ID, one document of each near-duplicate group, decontamination, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweft.llm import decontaminate, jaccard, langid, packing
from skillweft.llm.common import small, staged, workspace


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with the calibrated confidence; texts without a letter go."""
    model = langid.fit(langid.taught(docs))
    return langid.identify(docs, model).where("not lang_rejected").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the row with the smallest id. Texts without words are in no group and stay.

    Where ids are null or repeat, rows get numbers of their own in a written copy first; null ids come last in a group.
    """
    work = workspace(spark, "near")
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if odd.isEmpty():
        found = jaccard.jaccard_join(docs, work)
        return docs.join(small(staged(found.where("doc_id <> class_id").select("doc_id"), f"{work}/lost")), "doc_id", "left_anti").select(*docs.columns)
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), f"{work}/rows")
    found = staged(jaccard.jaccard_join(rows.select(F.col("_row").alias("doc_id"), "text"), work), f"{work}/found").select(F.col("doc_id").alias("_row"), F.col("class_id").alias("_class"))
    first = found.join(rows.select("_row", "doc_id"), "_row").groupBy("_class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    return rows.join(small(staged(first.select("_row"), f"{work}/first")), "_row", "left_semi").select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of the benchmark. Rows are told apart by id and text, so null and repeated ids don't matter."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key, work = F.xxhash64("doc_id", "text"), workspace(spark, "clean")
    found = decontaminate.contamination(docs.select(key.alias("doc_id"), "text"), benchmark, work).where(F.size("spans") > 0)
    lost = staged(found.select(F.col("doc_id").alias("_row")).distinct(), f"{work}/lost")
    return docs.withColumn("_row", key).join(small(lost), "_row", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 2048 ids."""
    _, placed = packing.pack(docs, workspace(spark, "packed"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("language_id", language), ("ngram_jaccard", one_of_each), ("decontamination", clean), ("packing", packed)]

#: Trained models and tokenizers can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, work = spark.read.parquet(f"{sf_dir}/documents.parquet"), workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{work}/{k}-{name}")
        docs = spark.read.parquet(f"{work}/{k}-{name}")
    return docs
