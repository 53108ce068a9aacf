"""Readers of golden sets, occupation tables and records, and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Categories of occupations by the first two digits of their code.
CATEGORIES = {"10": "management", "20": "professional", "30": "clerical", "40": "service", "50": "agriculture", "60": "production", "80": "other"}


def golden_set(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Labelled rows, one JSON object a line. The schema is given, so nothing is inferred; lines that are no objects are left out."""
    rows = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where(F.coalesce(*[F.col(c).isNotNull() for c in rows.columns if c != "_bad"]) & F.col("_bad").isNull()).drop("_bad")


def records(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None) -> DataFrame:
    """Crawled records as Parquet or JSON. A plain partitioned scan needs no paging."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(form).load(path)


def occupations(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """``code, name, category, definition, aliases`` from a CSV table with a header.

    Rows with a blank first cell or a comment are skipped; fewer than ``least`` rows are an error. Aliases are separated by
    semicolons, trimmed and distinct.
    """
    raw = spark.read.option("header", True).option("comment", "#").schema("code string, name string, definition string, aliases string").csv(path)
    rows = raw.where(F.trim(F.coalesce("code", F.lit(""))) != "")
    if rows.limit(least).count() < least:
        raise ValueError(f"{path} has fewer than {least} rows")
    return rows.select(F.trim("code").alias("code"), F.trim("name").alias("name"), category(F.col("code")).alias("category"), "definition", alias_list(F.col("aliases")).alias("aliases"))


def category(code: Column) -> Column:
    """S5."""
    table = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.substring(F.trim(code), 1, 2)), F.lit("other"))


def alias_list(text: Column) -> Column:
    """Aliases in the order of their first mention."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x)), lambda a: a != ""))


def job_titles(spark: SparkSession, path: str) -> DataFrame:
    """``code, aliases`` from a table ``code, title, source``: titles whose source has 09 or 10, in order, distinct."""
    raw = spark.read.option("header", True).schema("code string, title string, source string").csv(path).withColumn("_n", F.monotonically_increasing_id())
    kept = raw.where(F.col("source").contains("09") | F.col("source").contains("10"))
    first = kept.groupBy("code", F.trim("title").alias("title")).agg(F.min("_n").alias("n"))
    return first.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "title"))), lambda x: x["title"]).alias("aliases"))


def whitelist(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Names of standard skills from a list of ``{name: "...", category: "..."}`` lines, in the file's order. It is a vocabulary of hundreds."""
    lines = spark.read.option("wholetext", True).text(path).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^\s*-\s*\{\s*name:\s*\"([^\"]+)\""), F.lit(1))).alias("name"))
    return tuple(dict.fromkeys(r[0] for r in lines.collect()))


def prerequisites(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst`` of a table ``skill, prerequisites`` (separated by semicolons) with a header."""
    raw = spark.read.option("header", True).schema("skill string, prerequisites string").csv(path)
    return raw.select(F.trim("skill").alias("src"), F.explode(alias_list(F.col("prerequisites"))).alias("dst")).where("src <> ''")


def write_report(report: DataFrame, path: str, day: str) -> None:
    """A day's report as JSON; writing it again replaces it."""
    report.write.mode("overwrite").json(f"{path.rstrip('/')}/day={day}")
