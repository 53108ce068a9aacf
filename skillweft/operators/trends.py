"""Time series of skills and positions over graph versions and weeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillweft.functions import scores as S
from skillweft.sources.staging import small


def skill_windows(edges: DataFrame) -> DataFrame:
    """Edges into each skill by version; versions without one are left out."""
    return edges.groupBy("target", "version").agg(F.count("*").alias("freq"))


def trend_signals(freqs: DataFrame, key: str, period: str, floor: int = 10) -> DataFrame:
    """The last period of each key against all before: z, growth, class and confidence.

    Keys with one period have no history and give no signal. The sample deviation of one period is 0.
    """
    by = Window.partitionBy(key).orderBy(period)
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = freqs.select(key, period, "freq", F.avg("freq").over(past).alias("mean"), F.coalesce(F.stddev_samp("freq").over(past), F.lit(0.0)).alias("std"), F.lag("freq").over(by).alias("previous"), F.row_number().over(Window.partitionBy(key).orderBy(F.desc(period))).alias("rn"))
    z = F.when(F.col("freq") >= floor, S.zscore(F.col("freq"), F.col("mean"), F.col("std")))
    last = rows.where("rn = 1 and previous is not null").withColumn("z", z)
    return last.select(key, F.col("freq").alias("current_freq"), "mean", "std", "z", S.growth(F.col("freq"), F.col("previous")).alias("mom_growth"), S.trend(F.coalesce("z", F.lit(0.0)), F.col("freq"), floor).alias("trend"), S.z_confidence(F.col("z")).alias("confidence"))


def rank_signals(signals: DataFrame, key: str, trend: str, n: int) -> DataFrame:
    """The ``n`` most confident signals of a class; ties by key."""
    return signals.where(F.col("trend") == trend).orderBy(F.desc("confidence"), F.desc(F.abs("z")), key).limit(n)


def position_windows(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Out-degree of each named position in every version, 0 where there is none; ids of one name are added up.

    ``names`` has ``source, name``. The versions are few (90 days are kept); they are broadcast after they were counted.
    """
    counts = edges.groupBy("source", "version").agg(F.count("*").alias("n"))
    named = counts.join(names, "source").groupBy("name", "version").agg(F.sum("n").alias("n"))
    grid = names.select("name").distinct().join(small(edges.select("version").distinct(), 10_000), how="cross")
    return grid.join(named, ["name", "version"], "left").select("name", "version", F.coalesce("n", F.lit(0)).alias("freq"))


def series(freqs: DataFrame, key: str, period: str) -> DataFrame:
    """One row a key with its values in order of period as ``freqs``."""
    return freqs.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(period, "freq"))), lambda x: x["freq"].cast("double")).alias("freqs"))


def _recent(freqs: Column, n: int, earliest: bool) -> Column:
    return F.slice(freqs, 1, n) if earliest else F.when(F.size(freqs) <= n, freqs).otherwise(F.slice(freqs, -n, n))


def volatility(freqs: Column, n: int = 2, compat: bool = False) -> Column:
    """Spread of the last ``n`` values over their largest; ``compat``: of the first ``n``. 0 for fewer than two or none."""
    w = _recent(freqs, n, compat)
    return F.when(F.size(w) < 2, 0.0).otherwise(F.coalesce(F.try_divide(F.array_max(w) - F.array_min(w), F.array_max(w)), F.lit(0.0)))


def decline_rate(freqs: Column, n: int = 3, compat: bool = False) -> Column:
    """Loss from the first to the last of the last ``n`` values; ``compat``: of the first ``n``."""
    w = _recent(freqs, n, compat)
    return F.when(F.size(w) < 2, 0.0).otherwise(F.coalesce(F.try_divide(F.element_at(w, 1) - F.element_at(w, -1), F.element_at(w, 1)), F.lit(0.0)))


def freq_zscores(freqs: DataFrame, key: str, period: str) -> DataFrame:
    """Each value against its whole series, by the population deviation."""
    w = Window.partitionBy(key)
    return freqs.select(key, period, "freq", S.zscore(F.col("freq"), F.avg("freq").over(w), F.stddev_pop("freq").over(w)).alias("z"))


def recovery(z_scores: Column, n: int = 2) -> Column:
    """The last ``n`` scores are positive."""
    return (F.size(z_scores) >= n) & F.forall(F.slice(z_scores, -n, n), lambda z: z > 0)


def weekly_freqs(events: DataFrame, week: Column) -> DataFrame:
    """Mentions by skill, source and ISO week."""
    return events.groupBy("skill", "source", week.alias("week")).agg(F.count("*").alias("cnt"))


def watch_z(weekly: DataFrame) -> DataFrame:
    """The last week of each skill and source against those before; null for one week, hit from 2 up."""
    key = ["skill", "source"]
    past = Window.partitionBy(*key).orderBy("week").rowsBetween(Window.unboundedPreceding, -1)
    rows = weekly.select(*key, "week", "cnt", F.avg("cnt").over(past).alias("mean"), F.stddev_pop("cnt").over(past).alias("std"), F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("week"))).alias("rn"))
    still = F.when(F.col("mean") == 0, F.lit(None)).when(F.col("cnt") == F.col("mean"), 0.0).otherwise(F.when(F.col("cnt") > F.col("mean"), 2.0).otherwise(-2.0))
    z = F.when(F.col("mean").isNotNull(), F.when(F.col("std") == 0, still).otherwise((F.col("cnt") - F.col("mean")) / F.col("std")))
    return rows.where("rn = 1").select(*key, z.alias("z"), F.coalesce(z >= 2, F.lit(False)).alias("hit"))


def average_growth(freqs: DataFrame, key: str, period: str, window: int = 12) -> DataFrame:
    """Growth of the moving average at the last period; needs one more period than the window."""
    by = Window.partitionBy(key).orderBy(period)
    rows = freqs.select(key, period, F.avg("freq").over(by.rowsBetween(1 - window, 0)).alias("ma"), F.row_number().over(by).alias("n"), F.row_number().over(Window.partitionBy(key).orderBy(F.desc(period))).alias("rn")).withColumn("before", F.lag("ma").over(by))
    g = F.when((F.col("n") > window) & (F.col("before") > 0), (F.col("ma") - F.col("before")) / F.col("before"))
    return rows.where("rn = 1").select(key, "ma", g.alias("growth"), F.coalesce(g > 0.5, F.lit(False)).alias("hit"))


def watch_signals(z: DataFrame, growth: DataFrame, jd_sources: list[str]) -> DataFrame:
    """Ads (by their sources) signal by growth, everything else by z."""
    ads = growth.where(F.col("source").isin(jd_sources)).select("skill", "source", F.col("growth").alias("value"), "hit", F.lit("jd_growth").alias("kind"))
    return z.where(~F.col("source").isin(jd_sources)).select("skill", "source", F.col("z").alias("value"), "hit", F.lit("z").alias("kind")).unionByName(ads)


def anomaly_flags(signals: DataFrame, related: DataFrame, sources: list[str]) -> DataFrame:
    """For each position whether any related skill is hit in each of ``sources``. ``related``: ``name, skill``."""
    hits = related.join(signals.where("hit"), "skill", "left").groupBy("name")
    return hits.agg(*[F.coalesce(F.bool_or(F.col("source") == s), F.lit(False)).alias(s) for s in sources])


def promotable(signals: DataFrame, watched: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct hit skills that were watched before and are no candidates yet."""
    return signals.where("hit").select("skill").distinct().join(watched.select("skill"), "skill", "left_semi").join(known.select("skill"), "skill", "left_anti")


def skill_points(edges: DataFrame, skill: str, since: str) -> DataFrame:
    """A skill's count in every version from ``since`` on, 0 where it is missing."""
    versions = edges.where(F.col("version") >= since).select("version").distinct()
    counts = edges.where((F.col("target") == skill) & (F.col("version") >= since)).groupBy("version").agg(F.count("*").alias("freq"))
    return versions.join(counts, "version", "left").select("version", F.coalesce("freq", F.lit(0)).alias("freq"), F.col("freq").isNotNull().alias("present"))


def mli_overview(signals: DataFrame) -> DataFrame:
    """Latest value of each skill by class of source, and the index of the four."""
    latest = signals.groupBy("skill").pivot("class", ["paper", "course", "community", "jd"]).agg(F.max_by("value", "period"))
    value = S.mli(F.col("paper"), F.col("course"), F.col("community"), F.col("jd"))
    return latest.withColumn("mli", value).withColumn("ready", F.col("mli") > 0.6)
