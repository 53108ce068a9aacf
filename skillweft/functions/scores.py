"""Similarities, rates and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skillweft.functions import vocab as V


def jaccard(a: Column, b: Column) -> Column:
    """of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if a vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def wilson(successes: Column, total: Column, z: float = 1.96) -> Column:
    """lower bound of a share; 0 without trials."""
    p, n = successes / total, total.cast("double")
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.when(total > 0, F.greatest(low, F.lit(0.0))).otherwise(0.0)


def zscore(current: Column, mean: Column, std: Column) -> Column:
    """0 where nothing varies."""
    return F.when(std == 0, 0.0).otherwise((current - mean) / std)


def growth(current: Column, previous: Column) -> Column:
    """null after nothing."""
    return F.try_divide(current - previous, previous)


def trend(z: Column, current: Column, floor: int = 10) -> Column:
    """F24."""
    return F.when(current < floor, "protected").when(z > 2, "emerging").when(z > 1.5, "rising").when(z < -1.5, "declining").otherwise("stable")


def z_confidence(z: Column) -> Column:
    """F25."""
    return F.coalesce(F.least(F.abs(z) / 4, F.lit(1.0)), F.lit(0.0))


def share_of(value: Column, most: float) -> Column:
    """between 0 and 1."""
    return F.least(F.greatest(value, F.lit(0.0)) / most, F.lit(1.0))


def discovery_confidence(jds: Column, sources: Column, grown: Column, arxiv: Column, github: Column, weights: dict[str, float] | None = None) -> Column:
    """M6: weighted counts, sources and growth, with a bonus of 0.10 for one anomaly and 0.15 for both."""
    w = weights or V.DISCOVERY_WEIGHTS
    base = share_of(jds, 10.0) * w["count"] + share_of(sources, 4.0) * w["source"] + share_of(grown, 0.5) * w["growth"]
    return F.least(base + F.when(arxiv & github, 0.15).when(arxiv | github, 0.10).otherwise(0.0), F.lit(1.0))


def passes_gate(z: Column, sources: Column, ma3: Column, history_days: Column, successes: Column, total: Column) -> Column:
    """M5: with a history of 60 days by z, sources and level; before that by sources and the bound of the success rate."""
    usual = F.when(z > 2, (sources >= 2) & (ma3 >= 10)).when(z > 1.5, sources >= 2).otherwise(F.lit(False))
    return F.when(history_days < 60, (sources >= 3) & (wilson(successes, total) > 0.3)).when(z.isNull(), F.lit(False)).otherwise(usual)


def mli(paper: Column, course: Column, community: Column, jd_growth: Column) -> Column:
    """Mean of four signals as shares of two standard deviations, or of half."""
    return sum((share_of(F.coalesce(c, F.lit(0.0)), m) * 0.25 for c, m in ((paper, 2.0), (course, 2.0), (community, 2.0), (jd_growth, 0.5))), F.lit(0.0))


def ceiling(level: Column, table: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), level)


def inflation(level: Column, years: Column, skills: Column, experts: Column, education: Column, weights: dict[str, float] | None = None) -> Column:
    """M1: struct of four overflow scores, their weighted score, class and decay weight. ``education`` is a rank."""
    w = weights or V.INFLATION_WEIGHTS
    over = lambda value, table, full: F.least(F.greatest(F.coalesce(value, F.lit(0)) - ceiling(level, table), F.lit(0)) / full, F.lit(1.0))
    parts = {"experience": over(years, V.EXPERIENCE_CEILING, 5.0), "skill_count": over(skills, V.SKILL_CEILING, 6.0), "skill_depth": over(experts, V.EXPERT_CEILING, 3.0), "education": over(education, V.EDUCATION_CEILING, 2.0)}
    score = F.least(sum((parts[k] * w[k] for k in parts), F.lit(0.0)), F.lit(1.0))
    kind = F.when(score > 0.7, "severe_inflation").when(score >= 0.4, "mild_inflation").otherwise("normal")
    return F.struct(*[v.alias(k) for k, v in parts.items()], score.alias("score"), kind.alias("label"), F.when(score > 0.7, 0.4).when(score >= 0.4, 0.7).otherwise(1.0).alias("decay"))


def course_quality(platform: Column, rating: Column, enrolled: Column, started: Column, covered: Column, keywords: Column, as_of: Column) -> Column:
    """M3: struct of six parts, their weighted score and whether a course is recommended.

    ``covered``: share of its skills on the whitelist (null: none given); ``keywords``: project words in its description.
    """
    days = F.datediff(as_of, started)
    authority = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in V.PLATFORM_AUTHORITY.items() for x in kv]), F.lower(platform)), F.lit(0.5))
    rated = F.when(F.coalesce(rating, F.lit(0.0)) <= 0, 0.5).otherwise(F.least(rating / 5, F.lit(1.0)))
    joined = F.when(F.coalesce(enrolled, F.lit(0)) <= 0, 0.0).otherwise(F.least(F.log10(enrolled.cast("double")) / 5, F.lit(1.0)))
    recent = F.when(days.isNull(), 0.5).when(days <= 730, 1.0).when(days >= 1825, 0.5).otherwise(1.0 - (days - 730) * (0.5 / 1095))
    parts = {"platform": authority, "rating": rated, "enrollment": joined, "recency": recent, "coverage": F.coalesce(covered, F.lit(0.0)), "projects": F.least(F.coalesce(keywords, F.lit(0)) / 5.0, F.lit(1.0))}
    score = sum((parts[k] * w for k, w in (("platform", 0.25), ("rating", 0.20), ("enrollment", 0.15), ("recency", 0.20), ("coverage", 0.10), ("projects", 0.10))), F.lit(0.0))
    return F.struct(*[v.alias(k) for k, v in parts.items()], score.alias("score"), (score >= 0.65).alias("recommended"))


def staleness_penalty(updated: Column, as_of: Column) -> Column:
    """W22."""
    days = F.datediff(as_of, updated)
    return F.when(days > 365, 0.85).when(days > 180, 0.95).otherwise(1.0)


def freshness_factor(crawled: Column, as_of: Column) -> Column:
    """1 within a week and for unknown dates, 0.8 within 30 days, else 0.6."""
    days = F.datediff(as_of, crawled)
    return F.when(days.isNull() | (days <= 7), 1.0).when(days <= 30, 0.8).otherwise(0.6)


def is_must(must: Column, hits: Column, jds: Column, by_hits: bool = False) -> Column:
    """Of three ads or more, in over half of them; else in half of the hits. A10 (``by_hits``): always of the hits."""
    half = must / hits >= 0.5
    return half if by_hits else F.when(jds >= 3, must / jds > 0.5).otherwise(half)
