"""Source, freshness and cross-source quality of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweft.functions import scores as S
from skillweft.functions import text as X
from skillweft.functions import vocab as V


def source_distribution(rows: DataFrame) -> DataFrame:
    """A1: rows by source; blank is unknown."""
    return rows.groupBy(F.coalesce(X.blank_to_null(F.col("source")), F.lit("unknown")).alias("source")).agg(F.count("*").alias("cnt"))


def dedup_stats(rows: DataFrame, column: str = "fingerprint") -> DataFrame:
    """A2: rows, distinct non-empty fingerprints and the share of duplicates.

    The distinct values are counted in two steps (by value, then in all), so no task sees them all.
    """
    seen = rows.groupBy(F.nullif(F.col(column), F.lit("")).alias("f")).agg(F.count("*").alias("n"))
    stats = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("f").alias("unique"))
    lost = F.greatest(F.col("total") - F.col("unique"), F.lit(0))
    return stats.select("total", "unique", lost.alias("duplicates"), F.coalesce(F.try_divide(lost, F.col("total")), F.lit(0.0)).alias("rate"))


def cr10(mentions: DataFrame, n: int = 10) -> DataFrame:
    """A3: share of the ``n`` most frequent skills. ``mentions``: ``skill, cnt``, ties by name.

    The top is found by a bounded sort, not by ranking all skills in one task.
    """
    top = mentions.orderBy(F.desc("cnt"), "skill").limit(n).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("top"))
    total = mentions.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))
    return top.join(total, how="cross").select("top", "total", F.coalesce(F.try_divide(F.col("top"), F.col("total")), F.lit(0.0)).alias("cr10"))


def position_diversity(skills: DataFrame, ads: DataFrame) -> DataFrame:
    """A4: ads, positions, skills an ad, mentions, distinct skills and their concentration, in one row."""
    by_skill = skills.groupBy("skill").agg(F.count("*").alias("cnt"))
    c = cr10(by_skill)
    n = by_skill.agg(F.count("*").alias("unique_skills"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("mentions"))
    a = ads.agg(F.count("*").alias("jds"), F.countDistinct("position_name").alias("positions"))
    return a.join(n, how="cross").join(c, how="cross").select("jds", "positions", F.try_divide(F.col("mentions"), F.col("jds")).alias("avg_skills"), "mentions", "unique_skills", "cr10")


def course_diversity(courses: DataFrame) -> DataFrame:
    """A5: courses by platform and the distinct skills of each. ``courses``: ``platform, skills array``."""
    tags = courses.select("platform", F.explode("skills").alias("s")).groupBy("platform").agg(F.countDistinct("s").alias("skills"))
    return courses.groupBy("platform").agg(F.count("*").alias("courses")).join(tags, "platform", "left").select("platform", "courses", F.coalesce("skills", F.lit(0)).alias("skills"))


def freshness(rows: DataFrame, as_of: Column, days: float = 1.0) -> DataFrame:
    """Age of each source's latest record; a source without a readable time is not fresh."""
    last = rows.groupBy("source").agg(F.max(F.col("crawled_at")).alias("last"))
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("last")) / 86400
    return last.select("source", age.alias("days"), F.coalesce(age <= days, F.lit(False)).alias("fresh"))


def position_aggregate(skills: DataFrame) -> DataFrame:
    """Skills of each position: hits, must hits, distinct sources and the most frequent level (ties: first seen).

    ``skills``: ``id, seq, position_name, source, skill, necessity, level``, without duplicates and blank positions.
    """
    level = skills.groupBy("position_name", "skill", "level").agg(F.count("*").alias("n"), F.min(F.struct("id", "seq")).alias("first"))
    mode = level.groupBy("position_name", "skill").agg(F.min_by("level", F.struct(-F.col("n"), "first", "level")).alias("level"))
    per_ad = skills.groupBy("position_name", "skill", "id", "source").agg(F.bool_or(F.col("necessity") == "must").alias("must"))
    hits = per_ad.groupBy("position_name", "skill").agg(F.count("*").alias("hits"), F.count_if("must").alias("must"), F.countDistinct("source").alias("sources"))
    return hits.join(mode, ["position_name", "skill"])


def soft_skills(ads: DataFrame) -> DataFrame:
    """Of each position the whitelisted soft skills and how many ads name them, the most frequent first. ``ads``: ``id, position_name, soft_skills``."""
    named = ads.select("id", "position_name", F.explode(F.array_distinct("soft_skills")).alias("skill")).where(F.col("skill").isin(*V.SOFT_SKILLS))
    return named.groupBy("position_name", "skill").agg(F.count("*").alias("n"))


def ranked_soft_skills(counts: DataFrame) -> DataFrame:
    """The list of each position; there are twenty soft skills at most."""
    return counts.groupBy("position_name").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "skill"))), lambda x: x["skill"]).alias("soft_skills"))


def ad_stats(ads: DataFrame) -> DataFrame:
    """Ads of each position and their exact median of ``years``."""
    return ads.groupBy("position_name").agg(F.count("*").alias("jd_count"), F.median("years").alias("median_years"))


def requires_edges(aggregate: DataFrame, stats: DataFrame, by_hits: bool = False) -> DataFrame:
    """A9 (A10 with ``by_hits``): necessity and weight of each position's skills."""
    rows = aggregate.join(stats.select("position_name", "jd_count"), "position_name")
    must = S.is_must(F.col("must"), F.col("hits"), F.col("jd_count"), by_hits)
    return rows.withColumn("necessity", F.when(must, "must").otherwise("nice")).withColumn("weight", F.when(must, 0.8).otherwise(0.4))


def cross_validation(skills: DataFrame, ads: DataFrame, as_of: Column, per_source: bool = False) -> DataFrame:
    """Agreement of sources on each position.

    Skills of two sources or more are verified; salaries are outliers if the largest is over 1.5 times the smallest; experience
    diverges by distinct over given values. ``ads``: ``position_name, source, salary, experience, publish_date``.
    """
    seen = skills.groupBy("position_name", "skill").agg(F.countDistinct("source").alias("n"))
    verified = seen.groupBy("position_name").agg(F.count_if(F.col("n") >= 2).alias("verified"), F.count("*").alias("skills"), F.array_sort(F.collect_list(F.when(F.col("n") < 2, F.col("skill")))).alias("unverified"))
    pay = F.when(F.col("salary") > 0, F.col("salary"))
    groups = ads.groupBy("position_name").agg(
        F.countDistinct("source").alias("source_count"),
        F.median(pay).alias("salary_median"),
        (F.coalesce(F.try_divide(F.max(pay), F.min(pay)), F.lit(1.0)) > 1.5).alias("salary_outlier"),
        F.coalesce(F.try_divide(F.countDistinct("experience"), F.count("experience")), F.lit(0.0)).alias("divergence"),
        F.max("publish_date").alias("latest"),
    )
    if per_source:
        medians = ads.groupBy("position_name", "source").agg(F.median(pay).alias("m")).groupBy("position_name").agg((F.coalesce(F.try_divide(F.max("m"), F.min("m")), F.lit(1.0)) > 1.5).alias("salary_outlier"))
        groups = groups.drop("salary_outlier").join(medians, "position_name")
    ratio = F.coalesce(F.try_divide(F.col("verified"), F.col("skills")), F.lit(0.0))
    trust = F.least(F.col("source_count") / 3.0, F.lit(1.0)) * 0.4 + F.col("verified_ratio") * 0.4 + S.freshness_factor(F.col("latest"), as_of) * 0.2
    return groups.join(verified, "position_name", "left").withColumn("verified_ratio", ratio).withColumn("confidence", trust).drop("latest")


def validation_summary(groups: DataFrame) -> DataFrame:
    """A12."""
    return groups.agg(F.count("*").alias("positions"), F.count_if("salary_outlier").alias("outliers"), F.count_if(F.col("confidence") >= 0.6).alias("trusted"))


def outside_vocabulary(skills: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Ads that name a skill which isn't in ``vocabulary`` (``skill``), in any case, without noise."""
    per = skills.select("id", F.lower("skill").alias("skill")).distinct()
    known = vocabulary.select(F.lower("skill").alias("skill")).distinct()
    return per.join(known, "skill", "left_anti").where(~X.noise(F.col("skill"))).groupBy("skill").agg(F.count("*").alias("cnt"))


def crawl_status(rows: DataFrame, platforms: DataFrame, today: Column) -> DataFrame:
    """Total, today's count and latest time of every platform, 0 where it has none."""
    per = rows.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.to_date("crawled_at") == today).alias("today"), F.max("crawled_at").alias("last"))
    return platforms.join(per, "source", "left").select("source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("today", F.lit(0)).alias("today"), "last")


def state_histogram(rows: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """Rows in every state, 0 where there is none."""
    every = rows.sparkSession.createDataFrame([(s,) for s in states], "state string")
    return F.broadcast(every).join(rows.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))
