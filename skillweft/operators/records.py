"""Nested records: skills of ads, courses and résumés, lookups and listings.

An extraction is ``struct<position_name, requirements: array<struct<skill_name, necessity, level>>, skills: array<struct<name>>>``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweft.functions import text as X
from skillweft.functions import vocab as V

_NONE = "array<string>"


def _filled(a: Column) -> Column:
    return F.filter(F.coalesce(a, F.array().cast(_NONE)), lambda s: F.coalesce(s, F.lit("")) != "")


def skills_of(extraction: Column) -> Column:
    """Skills of the requirements, or of the skill list if there are none; empty names are left out."""
    req, own = extraction["requirements"], extraction["skills"]
    return F.when(F.coalesce(F.size(req), F.lit(0)) > 0, _filled(F.transform(req, lambda r: r["skill_name"]))).otherwise(_filled(F.transform(own, lambda s: s["name"])))


def position_skills(rows: DataFrame, extraction: str) -> DataFrame:
    """One row for each requirement with its necessity and level; skills without requirements are nice."""
    e = F.col(extraction)
    triple = lambda s, n, v: F.struct(s.alias("skill"), n.alias("necessity"), v.alias("level"))
    from_req = F.transform(e["requirements"], lambda r: triple(r["skill_name"], F.coalesce(r["necessity"], F.lit("nice")), F.coalesce(r["level"], F.lit(""))))
    from_own = F.transform(e["skills"], lambda s: triple(s["name"], F.lit("nice"), F.lit("")))
    listed = F.when(F.coalesce(F.size(e["requirements"]), F.lit(0)) > 0, from_req).otherwise(from_own)
    return rows.select(*[c for c in rows.columns if c != extraction], F.explode(listed).alias("x")).select("*", "x.*").drop("x").where("skill <> ''")


def source_skills(source: Column, skills: Column, categories: Column, language: Column, tags: Column, extracted: Column) -> Column:
    """Courses have skills, papers and communities categories, language and tags, ads extracted skills."""
    papers = _filled(F.concat(F.coalesce(categories, F.array().cast(_NONE)), F.array(language), F.coalesce(tags, F.array().cast(_NONE))))
    return F.when(source.isin(*V.COURSE_SOURCES), _filled(skills)).when(source.isin(*V.PAPER_SOURCES), papers).otherwise(_filled(extracted))


def merged_fields(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows with the fields that an edit gives."""
    fields = [c for c in new.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    return old.join(n, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns])


def invalid_positions(rows: DataFrame, standard: str) -> DataFrame:
    """C11: rows whose standard name is no single position."""
    return rows.where(F.col(standard).isin(*V.POLLUTED_POSITIONS))


def resume_rules(text: Column) -> Column:
    """struct of skills (names, then aliases, in their lists' order), first education level and years.

    Years stand beside the word for experience; else the first number of years that is no calendar year.
    """
    low = F.lower(text)
    names = [F.when(low.contains(w.lower()), F.lit(w)) for w in V.SKILL_WHITELIST] + [F.when(low.contains(a.lower()), F.lit(s)) for a, s in V.SKILL_ALIASES.items()]
    level = F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w in V.EDUCATION_LEVELS], F.lit(""))
    number = lambda p, g: F.nullif(F.regexp_extract(text, p, g), F.lit(""))
    years = F.coalesce(number(V.EXPERIENCE_IN_CONTEXT, 1), number(V.EXPERIENCE_IN_CONTEXT, 2), number(V.YEARS, 1)).try_cast("double")
    return F.struct(F.array_distinct(F.array_compact(F.array(*names))).alias("skills"), level.alias("education_level"), F.coalesce(years, F.lit(0.0)).alias("total_years"))


def resume_skills(skills: DataFrame, soft: DataFrame, key: str) -> DataFrame:
    """cleaned skills, the first of each name, marked if they are off the whitelist; soft skills that aren't named yet.

    ``skills``: ``key, seq, name, proficiency``; ``soft``: ``key, name``. Inferred soft skills have low confidence.
    """
    name = X.clean_skill(X.skill_alias(F.col("name")))
    # equal names are one row before they are cleaned, and combined before the shuffle: a common name is neither a large group nor cleaned often
    raw = skills.groupBy(key, "name").agg(F.min(F.struct("seq", "proficiency")).alias("r"))
    rows = raw.select(key, name.alias("name"), "r.seq", "r.proficiency").where((F.col("name") != "") & ~F.col("name").isin(*V.SKILL_STOPWORDS))
    first = rows.groupBy(key, F.lower("name").alias("_low")).agg(F.min(F.struct("seq", "name", "proficiency")).alias("m"))
    own = first.select(key, "m.name", "m.proficiency").select(key, "name", "proficiency", (~F.col("name").isin(*V.SKILL_WHITELIST)).alias("unmapped"), F.lit(False).alias("low_confidence"))
    inferred = soft.select(key, "name").distinct().select(key, name.alias("name")).where(F.col("name").isin(*V.SOFT_SKILLS)).distinct()
    named = own.select(key, F.lower("name").alias("_low"))
    more = inferred.withColumn("_low", F.lower("name")).join(named, [key, "_low"], "left_anti").select(key, "name", F.lit(2).alias("proficiency"), F.lit(False).alias("unmapped"), F.lit(True).alias("low_confidence"))
    return own.unionByName(more)


def golden_title(title: Column) -> Column:
    """without brackets; lists of languages are software developers."""
    t = F.trim(F.regexp_replace(title, "[（(][^)）]*[)）]", ""))
    many = t.contains("/") & t.rlike("岗|工程师|开发") & t.rlike("[a-zA-Z]+/[a-zA-Z]+")
    return F.when(many, "软件开发工程师").otherwise(F.trim(F.regexp_replace(t, r"\s+", " ")))


def golden_skills(tags: Column) -> Column:
    """tags that name skills, by their standard names, the first of each in any case."""
    kept = F.filter(tags, lambda t: ~t.isin(*V.NOT_SKILLS) & ~(t.contains("/") & t.rlike("天/|月|年/|周")))
    names = F.filter(F.transform(kept, lambda t: X.skill_alias(t)), lambda n: (F.length(n) >= 2) & ~n.rlike(r"^\d+$"))
    return F.filter(names, lambda n, i: F.array_position(F.transform(names, lambda m: F.lower(m)), F.lower(n)) == i + 1)


def golden_category(title: Column) -> Column:
    """the kind of position by the first keyword that a title holds, in its case."""
    rows = [F.when(reduce(lambda a, b: a | b, [title.contains(w) for w in words]), kind) for words, kind in V.GOLDEN_CATEGORIES]
    return F.coalesce(*rows, F.lit("其他"))


def remapped(name: Column, text: Column) -> Column:
    """A cleaned name; a fragment becomes the word that the ad has."""
    cleaned = X.clean_skill(X.skill_alias(name))
    out = cleaned
    for fragment, whole in V.FRAGMENTS.items():
        out = F.when((cleaned == fragment) & text.contains(whole), F.lit(whole)).otherwise(out)
    return out


# lookups and listings


def owned(files: DataFrame, cache: DataFrame, key: str, owner: str, who: object, order: str) -> DataFrame:
    """An owner's files with their parsed content, the latest first."""
    return files.where(F.col(owner) == who).join(cache, key).orderBy(F.desc(order), key)


def with_quality(rows: DataFrame, quality: DataFrame, key: list[str]) -> DataFrame:
    """Rows with their quality by a composite key, null where there is none."""
    return rows.join(quality, key, "left")


def position_detail(edges: DataFrame, necessity: str | None = None) -> DataFrame:
    """Skills of each position by weight, in lists of must and nice ones; ``necessity`` keeps one of them."""
    rows = edges if necessity is None else edges.where(F.col("necessity") == necessity)
    of = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("necessity") == k, F.struct((-F.col("weight")).alias("w"), "skill")))), lambda s: s["skill"])
    return rows.groupBy("position_name").agg(of("must").alias("must"), of("nice").alias("nice"))


def skill_evidence(evidence: DataFrame, skill: str) -> DataFrame:
    """A skill's evidence, the latest first."""
    return evidence.where(F.col("skill") == skill).orderBy(F.desc("crawled_at"), "ref")


def page(rows: DataFrame, order: list, number: int, size: int, where: Column | None = None) -> tuple[DataFrame, int]:
    """A page of the rows that pass a filter, and how many do."""
    kept = rows if where is None else rows.where(where)
    return kept.orderBy(*order).offset((number - 1) * size).limit(size), kept.count()


# embeddings


def project_text(name: Column, description: Column) -> Column:
    """M22."""
    n, d = F.coalesce(name, F.lit("")), F.coalesce(description, F.lit(""))
    return F.when(d == "", n).otherwise(F.concat(n, F.lit("："), d))


def ad_text(title: Column, company: Column, location: Column) -> Column:
    """M22."""
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (title, company, location)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _hashed(text: str, dim: int) -> np.ndarray:
    """Signed counts of a text's character trigrams and words, of length 1."""
    x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    three = _mixed(x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:])
    inside = x > 32
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    hashes = [three]
    if len(first):
        word = np.cumsum(np.concatenate([[False], inside[1:] & ~inside[:-1]]))  # of each character
        at = np.flatnonzero(inside)
        place = at - first[word[at] - 1]
        parts = _mixed(x[at] + place.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        hashes.append(_mixed(np.add.reduceat(parts, np.flatnonzero(np.diff(word[at], prepend=-1)))))
    h = np.concatenate(hashes)
    v = np.bincount((h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), dim)
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32)


def hashed_embedding(text: Column, dim: int = 384) -> Column:
    """A vector of length 1 from hashed character trigrams and words; the default where no model is plugged in."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([_hashed(t, dim) if t else np.zeros(dim, np.float32) for t in s.fillna("")])

    return run(text)


def backfilled(rows: DataFrame, done: DataFrame, key: str, text: str, embed=hashed_embedding) -> DataFrame:
    """``key, vector`` of done rows and of those that have none yet and some text; ``embed`` makes a vector column."""
    new = rows.join(done.select(key), key, "left_anti").where(F.coalesce(text, F.lit("")) != "")
    return done.select(key, "vector").unionByName(new.select(key, embed(F.col(text)).alias("vector")))
