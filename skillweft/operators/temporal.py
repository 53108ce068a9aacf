"""Age, zombie and plagiarism checks of ads within their position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweft.functions import scores as S
from skillweft.sources.staging import shared_path, small, staged


def first_seen(skills: DataFrame, as_of: Column) -> DataFrame:
    """Adds ``age``, days since the skill was first seen in the position, 0 at least."""
    seen = skills.groupBy("position_name", "skill").agg(F.min("publish_date").alias("first"))
    return skills.join(seen, ["position_name", "skill"]).withColumn("age", F.greatest(F.datediff(as_of, "first"), F.lit(0))).drop("first")


def sai(aged: DataFrame, as_of: Column, recent_days: int = 90) -> DataFrame:
    """Median age of an ad's skills over that of its position's ads of the last ``recent_days``; class and decay.

    Without either median the ratio is 0; over a median of 0 it is 3 unless the age is 0 too.
    """
    mine = aged.groupBy("id", "position_name").agg(F.median("age").alias("own"))
    recent = aged.where(F.datediff(as_of, "publish_date").between(0, recent_days)).groupBy("position_name").agg(F.median("age").alias("ref"))
    ratio = F.when(F.col("own").isNull() | F.col("ref").isNull(), 0.0).when(F.col("ref") == 0, F.when(F.col("own") > 0, 3.0).otherwise(0.0)).otherwise(F.col("own") / F.col("ref"))
    rows = mine.join(recent, "position_name", "left").withColumn("sai", ratio)
    return rows.select("id", "position_name", "sai", F.when(F.col("sai") > 2, "obsolete").when(F.col("sai") > 1.5, "stale").otherwise("fresh").alias("label"), F.when(F.col("sai") > 2, 0.0).when(F.col("sai") > 1.5, 0.5).otherwise(1.0).alias("weight"))


def zombies(sets: DataFrame, similar: float = 0.95) -> DataFrame:
    """How many of a position's other ads, from the latest back, have the current skill set in a row, and one.

    ``sets``: ``id, position_name, publish_date, skills`` (sorted distinct, not empty). Ads come in order of date and id. A set that isn't
    like that of the position's latest ad has no such ad. Only the few distinct sets that are like it are held against the
    position's other distinct sets, for the latest one that differs; the ads after that are counted. All of it are
    aggregations that combine before their shuffle, so a position with most of the ads is sorted nowhere.
    """
    when = F.struct("publish_date", "id")
    kinds = sets.groupBy("position_name", "skills").agg(F.max(when).alias("last"))
    kinds = staged(kinds, shared_path(sets.sparkSession, "kinds"))
    latest = kinds.groupBy("position_name").agg(F.max_by("skills", "last").alias("s1"))
    like = kinds.join(latest, "position_name").where(S.jaccard(F.col("skills"), F.col("s1")) >= similar).select("position_name", "skills")
    unlike = like.join(kinds.select("position_name", F.col("skills").alias("s2"), "last"), "position_name").where(S.jaccard(F.col("skills"), F.col("s2")) < similar)
    end = staged(like.join(unlike.groupBy("position_name", "skills").agg(F.max("last").alias("miss")), ["position_name", "skills"], "left"), shared_path(sets.sparkSession, "ends"))
    end = small(end)
    after = sets.select("position_name", when.alias("at")).join(end, "position_name").where(F.col("miss").isNull() | (F.col("at") > F.col("miss")))
    head = end.join(after.groupBy("position_name", "skills").agg(F.count("*").alias("head")), ["position_name", "skills"], "left")
    rows = sets.join(small(head), ["position_name", "skills"], "left")
    own = F.when(F.col("head").isNotNull() & (F.col("miss").isNull() | (when > F.col("miss"))), 1).otherwise(0)
    return rows.select("id", "position_name", (F.coalesce("head", F.lit(0)) - own + 1).cast("int").alias("run"))


def plagiarism(sets: DataFrame, days: int = 90) -> DataFrame:
    """An ad whose non-empty skills are all in the position's oldest ad, which is over ``days`` older."""
    oldest = sets.groupBy("position_name").agg(F.min_by(F.struct("id", "publish_date", "skills"), F.struct("publish_date", "id")).alias("old"))
    hit = (F.size("skills") > 0) & (F.size(F.array_except("skills", "old.skills")) == 0) & (F.datediff("publish_date", "old.publish_date") > days) & (F.col("id") != F.col("old.id"))
    return sets.join(oldest, "position_name").select("id", F.coalesce(hit, F.lit(False)).alias("plagiarised"))


def skill_sets(skills: DataFrame, column: str = "skill") -> DataFrame:
    """Sorted distinct skills of each ad."""
    return skills.groupBy("id", "position_name", "publish_date").agg(F.array_sort(F.collect_set(column)).alias("skills"))


def temporal_decay(*weights: Column) -> Column:
    """The smallest weight that is known."""
    return F.least(*weights)


def validate(skills: DataFrame, as_of: Column, set_column: str = "skill") -> DataFrame:
    """All checks of each ad and its decay."""
    work = shared_path(skills.sparkSession, "temporal")
    skills = staged(skills, f"{work}/skills")
    age = sai(first_seen(skills, as_of), as_of)
    sets = staged(skill_sets(skills, set_column), f"{work}/sets")
    runs = zombies(sets).drop("position_name")
    copied = plagiarism(sets)
    rows = age.join(runs, "id").join(copied, "id")
    zombie = (F.col("run") >= 4) & (F.col("sai") > 1.5)
    decay = temporal_decay(F.lit(1.0), F.col("weight"), F.when(zombie, 0.3).otherwise(1.0), F.when(F.col("plagiarised"), 0.4).otherwise(1.0))
    label = F.when(F.col("plagiarised"), "plagiarism").when(zombie, "zombie").otherwise(F.col("label"))
    return rows.select("id", "position_name", "sai", "run", zombie.alias("zombie"), "plagiarised", label.alias("label"), decay.alias("decay"))
