"""Named queries over life cycles, as a stream and as a replay, and over positioned text, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweft.operators import layout
from skillweft.plans.views import jd, table, with_views
from skillweft.sources.staging import shared_path
from skillweft.streaming import lifecycle


def _observations(spark: SparkSession, sf: str) -> DataFrame:
    """Ads and sources of each position and month; the confidence grows with the sources."""
    months = jd(spark, sf).groupBy("position_name", F.trunc("publish_date", "month").alias("d")).agg(F.count("*").cast("double").alias("freq"), F.countDistinct("source").alias("sources"))
    return months.select("position_name", F.col("d").cast("timestamp").alias("ts"), "freq", (0.5 + F.col("sources") / 8.0).alias("confidence"), "sources")


def life_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """M8, M9: the state of every position after each of its months, replayed from the table."""
    return lifecycle.replayed(_observations(spark, sf)).select("position_name", F.date_format("ts", "yyyy-MM").alias("month"), "state")


def life_cycle_stream(spark: SparkSession, sf: str) -> DataFrame:
    """M8, M9: the same from a stream that has a year's months in no order, read year by year; a last observation from far ahead moves the watermark past all."""
    rows, work = _observations(spark, sf), shared_path(spark, "cycle")
    years = [r[0] for r in rows.select(F.year("ts").alias("y")).distinct().orderBy("y").collect()]
    for y in years:
        rows.where(F.year("ts") == y).orderBy(F.xxhash64("position_name", "ts")).coalesce(1).write.mode("append").parquet(f"{work}/in")
    end = spark.createDataFrame([("", "2100-01-01 00:00:00", 0.0, 0.0, 0)], "position_name string, ts string, freq double, confidence double, sources long")
    end.select("position_name", F.col("ts").cast("timestamp").alias("ts"), "freq", "confidence", "sources").coalesce(1).write.mode("append").parquet(f"{work}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/in")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, lifecycle.ROCKSDB)
    try:  # the query has its own copy of the settings
        query = lifecycle.life_cycles(stream, "400 days").writeStream.outputMode("append").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{work}/out").start()
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    query.awaitTermination()
    found = spark.read.schema("position_name string, ts timestamp, state string").parquet(f"{work}/out")
    return found.where("position_name <> ''").select("position_name", F.date_format("ts", "yyyy-MM").alias("month"), "state")


def page_reflow(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a page with a box for each line on the left and one on the right; some have a box across the middle, some none on the right."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_linenumber", "l_returnflag", "l_quantity")
    top = F.col("l_linenumber") * 12.0 + F.col("l_quantity") / 30.0
    box = lambda x0, x1, y, text: F.struct(F.lit(x0).cast("double").alias("x0"), (x1 if not isinstance(x1, int) else F.lit(x1)).cast("double").alias("x1"), y.alias("top"), text.alias("text"))
    left = box(50, 50 + F.col("l_quantity") * 4, top, F.concat(F.lit("L"), F.col("l_linenumber").cast("string"), F.col("l_returnflag")))
    more = box(260, 270, top + 1.0, F.concat(F.lit("l"), F.col("l_linenumber").cast("string")))
    right = box(340, 400, top - 0.5, F.concat(F.lit("R"), F.col("l_linenumber").cast("string")))
    across = F.when((F.col("l_linenumber") == 1) & (F.col("doc") % 4 == 1), F.array(box(290, 310, F.lit(5.0), F.lit("HEAD")))).otherwise(F.array().cast("array<struct<x0: double, x1: double, top: double, text: string>>"))
    some = F.when(F.col("doc") % 4 == 2, F.array(left, more)).otherwise(F.array(left, more, right))
    boxes = lines.select("doc", F.lit(1).alias("page"), F.lit(600.0).alias("width"), F.inline(F.concat(some, across)))
    return layout.reflowed(boxes).select("doc", "two_column", F.regexp_replace("text", "\n", "/").alias("text"))


QUERIES = {f.__name__: f for f in (life_cycle, life_cycle_stream, page_reflow)}

_CYCLE = with_views("jd") + """a AS (SELECT position_name AS p, date_trunc('month', publish_date) AS d, CAST(count(*) AS DOUBLE) AS f, count(DISTINCT source) AS s FROM jd GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY d) AS i FROM a),
w AS (SELECT *, 0.5 + s / 8.0 AS c, lag(f) OVER q AS f1, lag(f, 2) OVER q AS f2, avg(f) OVER (q ROWS UNBOUNDED PRECEDING) AS mean FROM o WINDOW q AS (PARTITION BY p ORDER BY i)),
t AS (SELECT p, d, i, c >= 0.6 AND s >= 2 AS rises, c >= 0.8 AND s >= 2 AND f1 IS NOT NULL AND (greatest(f, f1) - least(f, f1)) / greatest(f, f1) < 0.25 AS settles, (coalesce(f2, f1) - f) / coalesce(f2, f1) > 0.4 AS falls, least(f, f1) > mean AND f1 IS NOT NULL AS recovers FROM w),
r(p, i, d, state) AS (SELECT DISTINCT p, CAST(0 AS BIGINT), CAST(NULL AS DATE), 'candidate' FROM t UNION ALL
  SELECT t.p, t.i, CAST(t.d AS DATE), CASE WHEN state = 'candidate' AND rises THEN 'emerging' WHEN state = 'emerging' AND settles THEN 'stable' WHEN state IN ('emerging', 'stable') AND falls THEN 'declining' WHEN state = 'declining' AND recovers THEN 'stable' ELSE state END FROM r JOIN t ON t.p = r.p AND t.i = r.i + 1)
SELECT p AS position_name, strftime(d, '%Y-%m') AS month, state FROM r WHERE i > 0"""

ORACLES = {
    "life_cycle": _CYCLE,
    "life_cycle_stream": _CYCLE,
    "page_reflow": """WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS n, l_linenumber * 12.0 + l_quantity / 30.0 AS y, l_quantity AS q, l_returnflag AS f FROM lineitem),
b AS (SELECT doc, 50.0 AS x0, 50 + q * 4 AS x1, y, 'L' || n || f AS t FROM l UNION ALL SELECT doc, 260, 270, y + 1, 'l' || n FROM l UNION ALL SELECT doc, 340, 400, y - 0.5, 'R' || n FROM l WHERE doc % 4 <> 2 UNION ALL SELECT doc, 290, 310, 5, 'HEAD' FROM l WHERE n = 1 AND doc % 4 = 1),
g AS (SELECT doc, bool_or(x1 <= 282) AND bool_or(x0 >= 318) AND NOT bool_or(x1 > 282 AND x0 < 318) AS two FROM b GROUP BY doc),
c AS (SELECT b.*, two, CASE WHEN two AND x0 >= 318 THEN 1 ELSE 0 END AS c FROM b JOIN g USING (doc)),
s AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc, c ORDER BY y, x0, t) > 3 THEN 1 ELSE 0 END AS new FROM c),
m AS (SELECT *, sum(new) OVER (PARTITION BY doc, c ORDER BY y, x0, t ROWS UNBOUNDED PRECEDING) AS line FROM s),
p AS (SELECT doc, two, c, line, string_agg(t, ' ' ORDER BY x0, t) AS t FROM m GROUP BY ALL)
SELECT doc, two AS two_column, string_agg(t, '/' ORDER BY c, line) AS text FROM p GROUP BY doc, two""",
}
