"""Named queries over time series, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweft.functions import scores as S
from skillweft.functions import text as X
from skillweft.operators import temporal, trends
from skillweft.plans.views import jd, jd_skill, snapshots, table, with_views

AS_OF = "2001-08-01"


def _as_of():
    return F.to_date(F.lit(AS_OF))


def _r(name: str, n: int = 6):
    return F.round(name, n).alias(name)


def _monthly(spark: SparkSession, sf: str) -> DataFrame:
    return trends.skill_windows(snapshots(spark, sf))


def trend_signals(spark: SparkSession, sf: str) -> DataFrame:
    """W1, W2."""
    s = trends.trend_signals(_monthly(spark, sf), "target", "version")
    return s.select(F.col("target").alias("skill"), "current_freq", _r("mean"), _r("std"), _r("z"), _r("mom_growth"), "trend", _r("confidence"))


def trend_rank_emerging(spark: SparkSession, sf: str) -> DataFrame:
    """The five most confident rising or falling signals of a class."""
    s = trends.trend_signals(_monthly(spark, sf), "target", "version")
    return trends.rank_signals(s, "target", "stable", 5).select(F.col("target").alias("skill"), "trend", _r("confidence"))


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    edges = snapshots(spark, sf)
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("source"), F.col("c_mktsegment").alias("name"))
    return trends.position_windows(edges, names)


def position_freq_windows(spark: SparkSession, sf: str) -> DataFrame:
    """W4."""
    return _segments(spark, sf)


def _series(spark: SparkSession, sf: str) -> DataFrame:
    return trends.series(_segments(spark, sf), "name", "version")


def window_volatility(spark: SparkSession, sf: str) -> DataFrame:
    """Of the last two windows and, as the reference has it, of the first two."""
    return _series(spark, sf).select("name", F.round(trends.volatility(F.col("freqs")), 6).alias("volatility"), F.round(trends.volatility(F.col("freqs"), compat=True), 6).alias("volatility_first"))


def decline_rate(spark: SparkSession, sf: str) -> DataFrame:
    """W6."""
    return _series(spark, sf).select("name", F.round(trends.decline_rate(F.col("freqs")), 6).alias("decline"), F.round(trends.decline_rate(F.col("freqs"), compat=True), 6).alias("decline_first"))


def freq_zscores(spark: SparkSession, sf: str) -> DataFrame:
    """W7."""
    return trends.freq_zscores(_segments(spark, sf), "name", "version").select("name", "version", "freq", _r("z"))


def recovery(spark: SparkSession, sf: str) -> DataFrame:
    """W8."""
    z = trends.freq_zscores(_segments(spark, sf), "name", "version")
    s = trends.series(z.select("name", "version", F.col("z").alias("freq")), "name", "version")
    return s.select("name", trends.recovery(F.col("freqs")).alias("recovered"))


def _weekly(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("skill"), F.col("event_type").alias("source"), "ts")
    return trends.weekly_freqs(e, X.week_key(F.col("ts")))


def weekly_freq(spark: SparkSession, sf: str) -> DataFrame:
    """A17, F17."""
    return _weekly(spark, sf)


def watch_z(spark: SparkSession, sf: str) -> DataFrame:
    """W9."""
    return trends.watch_z(_weekly(spark, sf)).select("skill", "source", _r("z"), "hit")


def ma_growth(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve-month moving averages of skills."""
    return trends.average_growth(_monthly(spark, sf), "target", "version").select(F.col("target").alias("skill"), _r("ma"), _r("growth"), "hit")


def ma3_growth(spark: SparkSession, sf: str) -> DataFrame:
    """Three-month moving averages of positions."""
    return trends.average_growth(_segments(spark, sf), "name", "version", 3).select("name", _r("ma"), _r("growth"))


def anomaly_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Users stand for skills, their tens for positions."""
    z = trends.watch_z(_weekly(spark, sf))
    related = z.select(F.concat(F.lit("p"), (F.col("skill") % 10).cast("string")).alias("name"), "skill").distinct()
    return trends.anomaly_flags(z, related, ["click", "purchase"])


def promotable(spark: SparkSession, sf: str) -> DataFrame:
    """Hit skills that were watched in the first week and weren't bought in the second."""
    weekly = _weekly(spark, sf)
    first = weekly.where(F.col("week") == "2024-W01").select("skill").distinct()
    known = weekly.where((F.col("source") == "purchase") & (F.col("week") == "2024-W02")).select("skill").distinct()
    return trends.promotable(trends.watch_z(weekly), first, known)


def skill_trend_points(spark: SparkSession, sf: str) -> DataFrame:
    """W21."""
    return trends.skill_points(snapshots(spark, sf), "Brand#11", "2000-07")


def _aged(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.first_seen(jd_skill(spark, sf), _as_of())


def skill_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Age of each skill in each position."""
    return _aged(spark, sf).select("position_name", "skill", F.col("age").cast("long").alias("age")).distinct()


def sai(spark: SparkSession, sf: str) -> DataFrame:
    """W16."""
    return temporal.sai(_aged(spark, sf), _as_of()).select("id", _r("sai"), "label", "weight")


def _sets(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.skill_sets(jd_skill(spark, sf), "flag")


def zombie(spark: SparkSession, sf: str) -> DataFrame:
    """W17."""
    return temporal.zombies(_sets(spark, sf)).select("id", F.col("run").cast("long").alias("run"))


def plagiarism(spark: SparkSession, sf: str) -> DataFrame:
    """W18."""
    return temporal.plagiarism(_sets(spark, sf))


def temporal_decay(spark: SparkSession, sf: str) -> DataFrame:
    """W19, W20."""
    rows = temporal.validate(jd_skill(spark, sf), _as_of(), "flag")
    return rows.select("id", _r("sai"), F.col("run").cast("long").alias("run"), "zombie", "plagiarised", "label", "decay")


def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    """Ads by label; plagiarism before zombie before age."""
    return temporal.validate(jd_skill(spark, sf), _as_of(), "flag").groupBy("label").agg(F.count("*").alias("n"))


def discovery_features(spark: SparkSession, sf: str) -> DataFrame:
    """Ads, sources and skills of each position."""
    s = jd_skill(spark, sf)
    return s.groupBy("position_name").agg(F.countDistinct("id").alias("jd_count"), F.countDistinct("source").alias("sources"), F.array_join(F.array_sort(F.collect_set("skill")), ",").alias("skills"))


def _inputs(spark: SparkSession, sf: str) -> DataFrame:
    ads = jd(spark, sf)
    per = ads.groupBy("position_name").agg(F.count("*").alias("jd_count"), F.countDistinct("source").alias("sources"), F.datediff(F.max("publish_date"), F.min("publish_date")).alias("history"))
    months = ads.where(F.col("publish_date") < "2001-07-01").groupBy("position_name", F.date_format("publish_date", "yyyy-MM").alias("version")).agg(F.count("*").alias("freq"))
    z = trends.trend_signals(months, "position_name", "version", 0).select("position_name", "z")
    ma = trends.average_growth(months, "position_name", "version", 3).select("position_name", "ma", "growth")
    return per.join(z, "position_name", "left").join(ma, "position_name", "left")


def discovery_gate(spark: SparkSession, sf: str) -> DataFrame:
    """M5, F21."""
    rows = _inputs(spark, sf)
    passes = S.passes_gate(F.col("z"), F.col("sources"), F.coalesce("ma", F.lit(0.0)), F.col("history"), F.col("sources"), F.col("jd_count"))
    return rows.select("position_name", passes.alias("passes"))


def confidence(spark: SparkSession, sf: str) -> DataFrame:
    """M6, M7."""
    rows = _inputs(spark, sf)
    c = S.discovery_confidence(F.col("jd_count"), F.col("sources"), F.coalesce("growth", F.lit(0.0)), F.col("sources") >= 5, F.col("history") > 2000)
    return rows.select("position_name", F.round(c, 6).alias("confidence"))


def wilson(spark: SparkSession, sf: str) -> DataFrame:
    """share of must lines by position."""
    s = jd_skill(spark, sf).groupBy("position_name").agg(F.count_if(F.col("necessity") == "must").alias("must"), F.count("*").alias("n"))
    return s.select("position_name", F.round(S.wilson(F.col("must"), F.col("n")), 6).alias("low"))


QUERIES = {f.__name__: f for f in (trend_signals, trend_rank_emerging, position_freq_windows, window_volatility, decline_rate, freq_zscores, recovery, weekly_freq, watch_z, ma_growth, ma3_growth, anomaly_flags, promotable, skill_trend_points, skill_first_seen, sai, zombie, plagiarism, temporal_decay, quality_report, discovery_features, discovery_gate, confidence, wilson)}

_FREQ = with_views("snapshots") + "f AS (SELECT target AS k, version AS v, count(*) AS freq FROM snapshots GROUP BY ALL)"
_SIGNAL = """, r AS (SELECT k, v, freq, avg(freq) OVER p AS mean, coalesce(stddev_samp(freq) OVER p, 0) AS std, lag(freq) OVER (PARTITION BY k ORDER BY v) AS previous, row_number() OVER (PARTITION BY k ORDER BY v DESC) AS rn FROM f WINDOW p AS (PARTITION BY k ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT k, freq AS current_freq, mean, std, (freq - previous) / previous AS mom_growth, CASE WHEN freq >= {floor} THEN CASE WHEN std = 0 THEN 0.0 ELSE (freq - mean) / std END END AS z FROM r WHERE rn = 1 AND previous IS NOT NULL),
t AS (SELECT *, CASE WHEN current_freq < {floor} THEN 'protected' WHEN z > 2 THEN 'emerging' WHEN z > 1.5 THEN 'rising' WHEN z < -1.5 THEN 'declining' ELSE 'stable' END AS trend, coalesce(least(abs(z) / 4, 1.0), 0.0) AS confidence FROM s)
"""
_SEG = with_views("snapshots") + """n AS (SELECT c_mktsegment AS name, version, count(*) AS n FROM snapshots JOIN customer ON source = c_custkey GROUP BY ALL),
w AS (SELECT name, version, CAST(coalesce(n.n, 0) AS BIGINT) AS freq FROM (SELECT DISTINCT c_mktsegment AS name FROM customer) CROSS JOIN (SELECT DISTINCT version FROM snapshots) LEFT JOIN n USING (name, version)),
a AS (SELECT name, list(CAST(freq AS DOUBLE) ORDER BY version) AS x FROM w GROUP BY name)"""
_Z7 = _SEG + ", z AS (SELECT name, version, freq, CASE WHEN stddev_pop(freq) OVER p = 0 THEN 0.0 ELSE (freq - avg(freq) OVER p) / stddev_pop(freq) OVER p END AS z FROM w WINDOW p AS (PARTITION BY name))"
_WEEK = "WITH w AS (SELECT user_id AS skill, event_type AS source, printf('%d-W%02d', isoyear(ts), weekofyear(ts)) AS week, count(*) AS cnt FROM events GROUP BY ALL)"
_WATCH = _WEEK + """, r AS (SELECT skill, source, cnt, avg(cnt) OVER p AS mean, stddev_pop(cnt) OVER p AS std, row_number() OVER (PARTITION BY skill, source ORDER BY week DESC) AS rn FROM w WINDOW p AS (PARTITION BY skill, source ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT skill, source, CASE WHEN mean IS NULL THEN NULL WHEN std = 0 THEN CASE WHEN mean = 0 THEN NULL WHEN cnt = mean THEN 0.0 WHEN cnt > mean THEN 2.0 ELSE -2.0 END ELSE (cnt - mean) / std END AS z FROM r WHERE rn = 1)"""
_MA = """, m AS (SELECT k, v, avg(freq) OVER (PARTITION BY k ORDER BY v ROWS BETWEEN {back} PRECEDING AND CURRENT ROW) AS ma, row_number() OVER (PARTITION BY k ORDER BY v) AS n, row_number() OVER (PARTITION BY k ORDER BY v DESC) AS rn FROM f),
g AS (SELECT k, ma, CASE WHEN n > {back} + 1 AND before > 0 THEN (ma - before) / before END AS growth FROM (SELECT *, lag(ma) OVER (PARTITION BY k ORDER BY v) AS before FROM m) WHERE rn = 1)"""
_AGE = with_views("jd", "jd_skill") + f"aged AS (SELECT *, greatest(date_diff('day', min(publish_date) OVER (PARTITION BY position_name, skill), DATE '{AS_OF}'), 0) AS age FROM jd_skill)"
_SAI = _AGE + f""", own AS (SELECT id, position_name, median(age) AS own FROM aged GROUP BY ALL),
ref AS (SELECT position_name, median(age) AS ref FROM aged WHERE date_diff('day', publish_date, DATE '{AS_OF}') BETWEEN 0 AND 90 GROUP BY ALL),
sai AS (SELECT id, position_name, CASE WHEN ref IS NULL THEN 0.0 WHEN ref = 0 THEN CASE WHEN own > 0 THEN 3.0 ELSE 0.0 END ELSE own / ref END AS sai FROM own LEFT JOIN ref USING (position_name)),
lab AS (SELECT *, CASE WHEN sai > 2 THEN 'obsolete' WHEN sai > 1.5 THEN 'stale' ELSE 'fresh' END AS label, CAST(CASE WHEN sai > 2 THEN 0.0 WHEN sai > 1.5 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS weight FROM sai)"""
_SETS = """, sets AS (SELECT id, position_name, publish_date, list_sort(list(DISTINCT flag)) AS s FROM jd_skill GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY position_name ORDER BY publish_date DESC, id DESC) AS rn FROM sets),
ds AS (SELECT position_name, s, min(rn) AS first FROM o GROUP BY ALL),
miss AS (SELECT a.position_name, a.s, min(b.first) AS miss FROM ds a JOIN ds b USING (position_name) WHERE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) < 0.95 GROUP BY ALL),
head AS (SELECT o.*, coalesce(miss - 1, count(*) OVER (PARTITION BY position_name)) AS head FROM o LEFT JOIN miss USING (position_name, s)),
zombie AS (SELECT id, CAST(head - CASE WHEN rn <= head THEN 1 ELSE 0 END + 1 AS BIGINT) AS run FROM head),
old AS (SELECT position_name, arg_min(id, (publish_date, id)) AS oid, min(publish_date) AS od, arg_min(s, (publish_date, id)) AS os FROM sets GROUP BY ALL),
plag AS (SELECT id, len(s) > 0 AND len(list_filter(s, lambda x: NOT list_contains(os, x))) = 0 AND date_diff('day', od, publish_date) > 90 AND id <> oid AS plagiarised FROM sets JOIN old USING (position_name))"""
_ALL = _SAI + _SETS + """, v AS (SELECT id, sai, run, run >= 4 AND sai > 1.5 AS zombie, plagiarised, CASE WHEN plagiarised THEN 'plagiarism' WHEN run >= 4 AND sai > 1.5 THEN 'zombie' ELSE label END AS label, CAST(least(weight, CASE WHEN run >= 4 AND sai > 1.5 THEN 0.3 ELSE 1.0 END, CASE WHEN plagiarised THEN 0.4 ELSE 1.0 END) AS DOUBLE) AS decay FROM lab JOIN zombie USING (id) JOIN plag USING (id))"""
_IN = with_views("jd") + "per AS (SELECT position_name, count(*) AS jd_count, count(DISTINCT source) AS sources, date_diff('day', min(publish_date), max(publish_date)) AS history FROM jd GROUP BY ALL), f AS (SELECT position_name AS k, strftime(publish_date, '%Y-%m') AS v, count(*) AS freq FROM jd WHERE publish_date < DATE '2001-07-01' GROUP BY ALL)" + _SIGNAL.format(floor=0) + _MA.format(back=2) + ", i AS (SELECT per.*, z, ma, growth FROM per LEFT JOIN t ON per.position_name = t.k LEFT JOIN g ON per.position_name = g.k)"
_W = "(p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)"

ORACLES = {
    "trend_signals": _FREQ + _SIGNAL.format(floor=10) + "SELECT k AS skill, current_freq, round(mean, 6) AS mean, round(std, 6) AS std, round(z, 6) AS z, round(mom_growth, 6) AS mom_growth, trend, round(confidence, 6) AS confidence FROM t",
    "trend_rank_emerging": _FREQ + _SIGNAL.format(floor=10) + "SELECT k AS skill, trend, round(confidence, 6) AS confidence FROM t WHERE trend = 'stable' ORDER BY t.confidence DESC, abs(z) DESC, k LIMIT 5",
    "position_freq_windows": _SEG + " SELECT name, version, freq FROM w",
    "window_volatility": _SEG + " SELECT name, round(coalesce((list_max(x[-2:]) - list_min(x[-2:])) / nullif(list_max(x[-2:]), 0), 0), 6) AS volatility, round(coalesce((list_max(x[:2]) - list_min(x[:2])) / nullif(list_max(x[:2]), 0), 0), 6) AS volatility_first FROM a",
    "decline_rate": _SEG + " SELECT name, round(coalesce((x[-3] - x[-1]) / nullif(x[-3], 0), 0), 6) AS decline, round(coalesce((x[1] - x[3]) / nullif(x[1], 0), 0), 6) AS decline_first FROM a",
    "freq_zscores": _Z7 + " SELECT name, version, freq, round(z, 6) AS z FROM z",
    "recovery": _Z7 + " SELECT name, bool_and(z > 0) AS recovered FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY version DESC) AS rn FROM z) WHERE rn <= 2 GROUP BY name",
    "weekly_freq": _WEEK + " SELECT * FROM w",
    "watch_z": _WATCH + " SELECT skill, source, round(z, 6) AS z, coalesce(z >= 2, false) AS hit FROM z",
    "ma_growth": _FREQ + _MA.format(back=11) + " SELECT k AS skill, round(ma, 6) AS ma, round(growth, 6) AS growth, coalesce(growth > 0.5, false) AS hit FROM g",
    "ma3_growth": _SEG + ", f AS (SELECT name AS k, version AS v, freq FROM w)" + _MA.format(back=2) + " SELECT k AS name, round(ma, 6) AS ma, round(growth, 6) AS growth FROM g",
    "anomaly_flags": _WATCH + " SELECT 'p' || (skill % 10) AS name, coalesce(bool_or(source = 'click' AND z >= 2), false) AS click, coalesce(bool_or(source = 'purchase' AND z >= 2), false) AS purchase FROM z GROUP BY ALL",
    "promotable": _WATCH + " SELECT DISTINCT skill FROM z WHERE z >= 2 AND skill IN (SELECT skill FROM w WHERE week = '2024-W01') AND skill NOT IN (SELECT skill FROM w WHERE source = 'purchase' AND week = '2024-W02')",
    "skill_trend_points": with_views("snapshots") + "c AS (SELECT version, count(*) AS n FROM snapshots WHERE target = 'Brand#11' GROUP BY ALL) SELECT version, CAST(coalesce(n, 0) AS BIGINT) AS freq, n IS NOT NULL AS present FROM (SELECT DISTINCT version FROM snapshots WHERE version >= '2000-07') LEFT JOIN c USING (version)",
    "skill_first_seen": _AGE + " SELECT DISTINCT position_name, skill, age FROM aged",
    "sai": _SAI + " SELECT id, round(sai, 6) AS sai, label, weight FROM lab",
    "zombie": with_views("jd", "jd_skill") + _SETS[2:] + " SELECT id, run FROM zombie",
    "plagiarism": with_views("jd", "jd_skill") + _SETS[2:] + " SELECT id, plagiarised FROM plag",
    "temporal_decay": _ALL + " SELECT id, round(sai, 6) AS sai, run, zombie, plagiarised, label, decay FROM v",
    "quality_report": _ALL + " SELECT label, count(*) AS n FROM v GROUP BY label",
    "discovery_features": with_views("jd", "jd_skill")[:-2] + " SELECT position_name, count(DISTINCT id) AS jd_count, count(DISTINCT source) AS sources, array_to_string(list_sort(list(DISTINCT skill)), ',') AS skills FROM jd_skill GROUP BY ALL",
    "discovery_gate": _IN + f", q AS (SELECT *, sources / jd_count AS p, CAST(jd_count AS DOUBLE) AS n FROM i) SELECT position_name, CASE WHEN history < 60 THEN sources >= 3 AND greatest({_W}, 0) > 0.3 WHEN z IS NULL THEN false WHEN z > 2 THEN sources >= 2 AND coalesce(ma, 0) >= 10 WHEN z > 1.5 THEN sources >= 2 ELSE false END AS passes FROM q",
    "confidence": _IN + " SELECT position_name, round(least(least(jd_count / 10, 1.0) * 0.4 + least(sources / 4, 1.0) * 0.3 + least(greatest(coalesce(growth, 0), 0) / 0.5, 1.0) * 0.3 + CASE WHEN sources >= 5 AND history > 2000 THEN 0.15 WHEN sources >= 5 OR history > 2000 THEN 0.10 ELSE 0.0 END, 1.0), 6) AS confidence FROM i",
    "wilson": with_views("jd", "jd_skill") + f"c AS (SELECT position_name, count_if(necessity = 'must') / count(*) AS p, CAST(count(*) AS DOUBLE) AS n FROM jd_skill GROUP BY ALL) SELECT position_name, round(greatest({_W}, 0), 6) AS low FROM c",
}
