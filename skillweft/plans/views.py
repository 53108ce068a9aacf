"""Domain views over the relational tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ads: ``id, source, publish_date, position_name, company, salary``.

    The nation table has a row for each country, so it is broadcast; customers and orders meet on their key.
    """
    t = lambda n: table(spark, sf_dir, n)
    who = t("customer").join(F.broadcast(t("nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws("/", "c_mktsegment", "n_name").alias("position_name"))
    return t("orders").join(who, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"), F.to_date("o_orderdate").alias("publish_date"), "position_name", F.col("o_custkey").alias("company"), F.col("o_totalprice").alias("salary"))


#: Lines that one task joins with their ads and counts by ad, about; tasks are as many as this takes, so that none holds more on a larger table.
LINES_A_TASK = 1 << 18


def dealt(rows: DataFrame, lines: int, *keys: str) -> DataFrame:
    """Rows by their keys in as many tasks as ``lines`` need."""
    return rows.repartition(max(1, math.ceil(lines / LINES_A_TASK)), *keys)


def jd_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills of ads: ``id, seq, skill, necessity, level, weight, flag`` and the ad's columns.

    Both sides are dealt by ad to as many tasks as the lines' number needs: session-wide partitions, or small ones that AQE puts together by their
    compressed bytes, would hold more and more lines. What counts by ad afterwards needs no other shuffle.
    """
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("seq"), F.col("p_brand").alias("skill"), F.when(F.col("l_returnflag") != "N", "must").otherwise("nice").alias("necessity"), F.col("l_linestatus").alias("level"), F.col("l_quantity").alias("weight"), F.col("l_returnflag").alias("flag"))
    n = t("lineitem").count()  # the files' footers know
    return dealt(lines, n, "id").join(dealt(jd(spark, sf_dir), n, "id"), "id")


def snapshots(spark: SparkSession, sf_dir: str, end: str = "2001-07-01") -> DataFrame:
    """Monthly graph versions: ``version, source`` (customer) and ``target`` (skill), distinct edges of whole months."""
    t = lambda n: table(spark, sf_dir, n)
    orders = t("orders").where(F.col("o_orderdate") < end).select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("version"))
    lines = t("lineitem").select("l_orderkey", "l_partkey").join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("version", F.col("o_custkey").alias("source"), F.col("p_brand").alias("target")).distinct()


def requires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges ``position_name, skill, weight`` (ads with the skill)."""
    return jd_skill(spark, sf_dir).groupBy("position_name", "skill").agg(F.countDistinct("id").alias("weight"))


#: Chinese words for a position's segment (three of one meaning), and what stands before them by the nation's number.
CHINESE = {"BUILDING": ("算法", "数据工程", "工程师"), "AUTOMOBILE": ("数据",), "MACHINERY": ("前端",), "HOUSEHOLD": ("测试",), "FURNITURE": ("产品",)}
BEFORE = ("人工智能", "高级", "", "云计算")


def chinese(position: Column) -> Column:
    """A Chinese name for a position ``SEGMENT/NATION_n``, without spaces."""
    word = F.create_map(*[F.lit(x) for k, v in CHINESE.items() for x in (k, v[0])])[F.substring_index(position, "/", 1)]
    return F.concat(F.element_at(F.array(*map(F.lit, BEFORE)), F.substring_index(position, "_", -1).cast("int") % 4 + 1), F.coalesce(word, F.lit("其他")), F.lit("工程师"))


#: The same views for the oracle; a query's SQL begins with the ones that it needs.
SQL = {
    "jd": "jd AS (SELECT o_orderkey AS id, o_orderpriority AS source, CAST(o_orderdate AS DATE) AS publish_date, c_mktsegment || '/' || n_name AS position_name, o_custkey AS company, o_totalprice AS salary FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)",
    "jd_skill": "jd_skill AS (SELECT jd.*, l_linenumber AS seq, p_brand AS skill, CASE WHEN l_returnflag <> 'N' THEN 'must' ELSE 'nice' END AS necessity, l_linestatus AS level, l_quantity AS weight, l_returnflag AS flag FROM lineitem JOIN part ON l_partkey = p_partkey JOIN jd ON id = l_orderkey)",
    "snapshots": "snapshots AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS version, o_custkey AS source, p_brand AS target FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderdate < TIMESTAMP '2001-07-01')",
    "requires": "requires AS (SELECT position_name, skill, count(DISTINCT id) AS weight FROM jd_skill GROUP BY ALL)",
}


_WORD = "CASE split_part(position_name, '/', 1) " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in CHINESE.items()) + " ELSE '其他' END"
SQL["chinese"] = f"chinese AS (SELECT position_name AS name FROM jd UNION SELECT ([{', '.join(repr(b) for b in BEFORE)}])[CAST(split_part(position_name, '_', -1) AS INT) % 4 + 1] || {_WORD} || '工程师' FROM jd)"


def with_views(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names) + (", " if names else "")
