"""Incremental forms of weekly counts and raw upserts. They go beyond batch: late rows are bounded by watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skillweft.operators import ingest


def weekly_counts(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """A17 over a stream ``skill, source, ts``: mentions in windows of seven days from Monday; rows later than ``late`` are left out."""
    weeks = F.window("ts", "7 days", startTime="4 days")  # the epoch was a Thursday
    return stream.withWatermark("ts", late).groupBy("skill", "source", weeks.alias("w")).agg(F.count("*").alias("cnt")).select("skill", "source", F.col("w.start").alias("week_start"), "cnt")


def first_seen(stream: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """S2 over a stream: each key once within the watermark, so the state stays bounded."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def upsert_sink(stream: DataFrame, path: str, key: list[str], checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """S2 as a sink: each micro-batch replaces its keys below ``path``; a batch that is run again gives the same table.

    Keys are dealt to ``buckets`` by a hash. A batch writes the buckets that it touches to a folder of its own, and then a list of
    the version that each bucket is at, so a failed batch leaves the last version whole. ``upserted`` reads the table.
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        new = ingest.latest(rows, key, [F.desc("ts"), F.xxhash64(*rows.columns)]).withColumn("_b", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in new.select("_b").distinct().collect()]
        versions = _versions(spark, path, batch - 1)
        if held := [f"{path}/v={versions[b]}/_b={b}" for b in touched if b in versions]:
            old = spark.read.schema(rows.schema).parquet(*held).withColumn("_b", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
            new = ingest.upsert(old, new, key)
        new.repartition("_b").write.partitionBy("_b").mode("overwrite").parquet(f"{path}/v={batch}")
        versions |= dict.fromkeys(touched, batch)
        spark.createDataFrame(sorted(versions.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/_versions/{batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str, batch: int) -> dict[int, int]:
    """The version of each bucket after a batch: as many numbers as there are buckets."""
    return {} if batch < 0 else {r[0]: r[1] for r in spark.read.schema("bucket int, version long").parquet(f"{path}/_versions/{batch}").collect()}


def upserted(spark: SparkSession, path: str, schema: str, batch: int) -> DataFrame:
    """The table of ``upsert_sink`` after a batch."""
    return spark.read.schema(schema).parquet(*[f"{path}/v={v}/_b={b}" for b, v in sorted(_versions(spark, path, batch).items())])
