"""Candidates against positions: scores, gaps and learning paths, for any number of candidates at once.

``positions``: ``position_name, skill, necessity, weight, proficiency, source_count``; ``candidates``: ``candidate, skill,
proficiency, low_confidence``. Skills are canonical names.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillweft.functions import scores as S
from skillweft.functions import vocab as V


def position_requirements(edges: DataFrame, soft: DataFrame) -> DataFrame:
    """Requirements of positions with soft skills as nice ones of weight 0.4; null weights are 1, null counts 1."""
    hard = edges.select("position_name", "skill", "necessity", F.coalesce("weight", F.lit(1.0)).alias("weight"), "proficiency", F.coalesce("source_count", F.lit(1)).alias("source_count"))
    extra = soft.select("position_name", F.explode("soft_skills").alias("skill"), F.lit("nice").alias("necessity"), F.lit(0.4).alias("weight"), F.lit(None).cast("string").alias("proficiency"), F.lit(1).alias("source_count"))
    return hard.unionByName(extra)


def candidate_skills(parsed: DataFrame) -> DataFrame:
    """Skills of candidates given as names or objects; without a proficiency it is 2.

    ``parsed``: ``candidate, skills array<string>`` whose elements are a name or a JSON object.
    """
    s = parsed.select("candidate", F.explode("skills").alias("s"))
    obj = F.from_json("s", "name string, proficiency int, low_confidence boolean")
    return s.select("candidate", F.coalesce(obj["name"], F.col("s")).alias("skill"), F.coalesce(obj["proficiency"], F.lit(2)).alias("proficiency"), F.coalesce(obj["low_confidence"], F.lit(False)).alias("low_confidence"))


def cii_corrected(positions: DataFrame, most: int = 7, share: float = 0.2) -> DataFrame:
    """Of over ``most`` must skills, a ``share`` with the least weight becomes nice; expert skills of 30 sources are safe."""
    must = F.col("necessity") == "must"
    n = F.sum(F.when(must, 1).otherwise(0)).over(Window.partitionBy("position_name"))
    open_ = must & ~((F.coalesce("proficiency", F.lit("")) == "专家") & (F.col("source_count") >= 30))
    rank = F.row_number().over(Window.partitionBy("position_name", open_).orderBy("weight", "source_count", "skill"))
    rows = positions.withColumn("_n", n).withColumn("_open", open_).withColumn("_rank", rank)
    demote = F.col("_open") & (F.col("_n") > most) & (F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share)))
    return rows.withColumn("demoted", demote).withColumn("necessity", F.when(demote, "nice").otherwise(F.col("necessity"))).drop("_n", "_open", "_rank")


#: Positions, and bytes of their skills' names, that are sent to all tasks at once; with more, candidates and positions meet by their skills.
FEW_POSITIONS, FEW_BYTES = 5_000, 8 << 20
#: Different skills of all positions together that are numbered, with a bit in a word of each candidate and an entry of its array.
FEW_SKILLS = 256
#: Must and nice skills of a position together up to which sums over them are compiled; more wouldn't fit what the JVM compiles of one method.
FEW_TERMS = 28
#: Rows of candidates' skills, or of their pairs with positions, that one task ranks and scores, about; tasks are as many as this takes, so that none holds more of a larger table.
SKILLS_A_TASK = 1 << 18


def _few_skills(positions: DataFrame) -> int | None:
    """How many skills the positions have, if both are counted to be few, so that skills can be numbered and all positions sent to every task."""
    n = positions.select("skill").where("skill is not null").distinct().limit(FEW_SKILLS + 1).count()
    count, size = positions.agg(F.countDistinct("position_name"), F.coalesce(F.sum(F.octet_length("skill") + 24), F.lit(0))).first()
    return n if n <= FEW_SKILLS and count <= FEW_POSITIONS and size <= FEW_BYTES else None


def _tasks(candidates: DataFrame, positions: DataFrame | None = None) -> int:
    """For candidates' skills; with ``positions`` for all pairs, too, which are estimated."""
    rows, n = candidates.agg(F.count("*"), F.approx_count_distinct("candidate")).first()
    pairs = n * positions.agg(F.countDistinct("position_name")).first()[0] if positions is not None else 0
    return max(1, math.ceil(max(rows, pairs) / SKILLS_A_TASK))


def _numbered(positions: DataFrame) -> DataFrame:
    """``at, skill``: the few skills of all positions, numbered by name."""
    return F.broadcast(positions.agg(F.array_sort(F.collect_set("skill")).alias("s")).select(F.posexplode("s").alias("at", "skill")))


def _bits(words: range, own: Column | None = None) -> list[Column]:
    """Numbers ``at`` of a group, those that are its ``own`` only, as bits of words ``w0, w1 ...``."""
    of = lambda w: F.shiftright("at", 6) == w if own is None else own & (F.shiftright("at", 6) == w)
    return [F.coalesce(F.bit_or(F.when(of(w), F.expr("shiftleft(1L, at % 64)"))), F.lit(0).cast("long")).alias(f"w{w}") for w in words]


def _hits(candidates: DataFrame, positions: DataFrame) -> DataFrame:
    """All pairs with a common skill, and how many they have."""
    return candidates.select("candidate", "skill").distinct().join(positions.select("position_name", "skill").distinct(), "skill").groupBy("candidate", "position_name").agg(F.count("*").alias("hits"))


def rough_select(candidates: DataFrame, positions: DataFrame, k: int = 200) -> DataFrame:
    """For each candidate the ``k`` positions with the most common skills; ties by name.

    Positions are aggregates. If they are counted to be few, all of them are one broadcast row, and a candidate's best are found
    in its own row: no pairs are shuffled or ranked, and no skill is a key. Few skills are bits, and common ones are counted by words of them. The
    result is the same either way.
    """
    if (n := _few_skills(positions)) is not None:
        return _by_bits(candidates, positions, k, n)
    want = positions.groupBy("position_name").agg(F.collect_set("skill").alias("want"))
    count, size = want.agg(F.count("*"), F.coalesce(F.sum(F.aggregate("want", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 8)), F.lit(0))).first()
    if count <= FEW_POSITIONS and size <= FEW_BYTES:
        every = want.agg(F.array_sort(F.collect_list(F.struct("position_name", "want"))).alias("every"))
        rows = candidates.groupBy("candidate").agg(F.collect_set("skill").alias("have")).join(F.broadcast(every), how="cross")
        hits = F.transform("every", lambda p: F.struct((-F.size(F.array_intersect("have", p["want"]))).alias("n"), p["position_name"].alias("position_name")))
        best = F.slice(F.array_sort(F.filter(hits, lambda h: h["n"] < 0)), 1, k)
        return rows.select("candidate", F.explode(best).alias("b")).select("candidate", "b.position_name", (-F.col("b.n")).cast("long").alias("hits"))
    w = Window.partitionBy("candidate").orderBy(F.desc("hits"), "position_name")
    return _hits(candidates, positions).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("candidate", "position_name", "hits")


def _by_bits(candidates: DataFrame, positions: DataFrame, k: int, skills: int) -> DataFrame:
    """``rough_select`` for few skills. A position is one number: its place by name, less its hits times the number of positions, so that a sort of numbers ranks them."""
    at, words = _numbered(positions), range(skills // 64 + 1)
    bits = _bits(words)
    want = positions.join(at, "skill").groupBy("position_name").agg(*bits)
    every = want.agg(F.array_sort(F.collect_list(F.struct("position_name", *[f"w{w}" for w in words]))).alias("every"))
    rows = candidates.join(at, "skill").groupBy("candidate").agg(*bits).repartition(_tasks(candidates), "candidate").join(F.broadcast(every), how="cross")
    common = lambda p: sum((F.bit_count(F.col(f"w{w}").bitwiseAND(p[f"w{w}"])) for w in words[1:]), F.bit_count(F.col("w0").bitwiseAND(p["w0"])))
    ranked = F.sort_array(F.filter(F.transform("every", lambda p, i: i - common(p) * F.size("every")), lambda x: x < 0))
    name = lambda x: F.get("every", F.pmod(x, F.size("every")))["position_name"].alias("position_name")
    hits = lambda x: F.ceil(-x / F.size("every")).cast("long").alias("hits")
    best = F.transform(F.slice(ranked, 1, k), lambda x: F.struct(name(x), hits(x)))
    return rows.select("candidate", F.explode(best).alias("b")).select("candidate", "b.position_name", "b.hits")


def _total(n: int, x, compiled: bool = False) -> Column:
    """Sum of ``x(0)`` to ``x(n - 1)`` in this order. With weights that is from the largest down, above and below the line of a share alike, so that a share of all is exactly 1."""
    if compiled:
        return sum(map(x, map(F.lit, range(n))), F.lit(0.0))
    return F.aggregate(F.slice(F.sequence(F.lit(0), F.lit(n)), 1, n), F.lit(0.0), lambda s, i: s + x(i))


def _in_rows(owned: DataFrame, years: DataFrame, positions: DataFrame, meta: DataFrame, chosen: DataFrame | None, skills: int, tasks: int) -> DataFrame:
    """Sums and lists of pairs, each in its own row: a candidate's similarities are one array by skills' numbers, positions' lists are sent to all tasks.

    Only candidates' skills are shuffled, once and by candidate; their pairs and pairs' skills never are. Without ``chosen`` a candidate meets every position that
    has a bit of its own skills.
    """
    at, words, must, nice = _numbered(positions), range(skills // 64 + 1), F.col("necessity") == "must", F.col("necessity") == "nice"
    want = positions.where("position_name is not null").join(at, "skill", "left").groupBy("position_name").agg(
        F.count_if(must).alias("musts"),
        F.array_sort(F.collect_list(F.when(must, F.struct("skill", "at")))).alias("must"),
        F.sort_array(F.collect_list(F.when(nice, F.struct("weight", "source_count", "skill", "at"))), False).alias("nice"),
        *_bits(words),
    )
    longest = want.agg(*[F.coalesce(F.max(F.size(c)), F.lit(0)) for c in ("must", "nice")]).first()
    padded = lambda x, n, of, pad: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.coalesce(F.get(x, i)[of], F.lit(pad)))
    want = want.join(meta, "position_name", "left").withColumns({
        "must_at": padded("must", longest[0], "at", skills),  # behind the last skill's similarity is a 0, for what no candidate has
        "nice_at": padded("nice", longest[1], "at", skills),
        "nice_weight": padded("nice", longest[1], "weight", 0.0),
    }).withColumn("nice_sum", _total(longest[1], lambda i: F.get("nice_weight", i))).withColumnsRenamed({f"w{w}": f"_w{w}" for w in words})
    have = owned.join(at, "skill").groupBy("candidate").agg(F.map_from_entries(F.collect_list(F.struct("at", "sim"))).alias("m"), *_bits(words, F.col("own")))
    have = have.withColumn("sims", F.transform(F.sequence(F.lit(0), F.lit(skills)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))).drop("m")
    if chosen is None:
        common = functools.reduce(Column.__or__, (F.col(f"w{w}").bitwiseAND(F.col(f"_w{w}")) != 0 for w in words))
        rows = have.join(years.repartition(tasks, "candidate"), "candidate", "left").join(F.broadcast(want), common)
    else:
        rows = chosen.select("candidate", "position_name").distinct().join(have, "candidate", "left").join(years, "candidate", "left").join(F.broadcast(want), "position_name")  # lists come after what is sorted
        rows = rows.withColumn("sims", F.coalesce("sims", F.array_repeat(F.lit(0.0), skills + 1)))
    sim, compiled = lambda i: F.get("sims", i), sum(longest) <= FEW_TERMS
    listed = lambda of: F.transform(F.filter("must", lambda s: s["at"].isNotNull() & of(sim(s["at"]))), lambda s: s["skill"])
    return rows.select(
        "candidate", "position_name", "musts", "total_years", "required_years", "staleness",
        F.coalesce(F.try_divide(_total(longest[0], lambda i: sim(F.get("must_at", i)), compiled), F.col("musts")), F.lit(1.0)).alias("must_score"),
        F.coalesce(F.try_divide(_total(longest[1], lambda i: sim(F.get("nice_at", i)) * F.get("nice_weight", i), compiled), F.col("nice_sum")), F.lit(1.0)).alias("nice_score"),
        listed(lambda x: x > 0).alias("matched_must"),
        listed(lambda x: x == 0).alias("missing_must"),
    )


def _by_joins(owned: DataFrame, positions: DataFrame, chosen: DataFrame) -> DataFrame:
    """The same by a row for each skill of a chosen pair, for any number of positions and skills."""
    wanted = chosen.select("candidate", "position_name").distinct().join(positions, "position_name")
    rows = wanted.join(owned.select("candidate", "skill", "sim"), ["candidate", "skill"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    must, nice = F.col("necessity") == "must", F.col("necessity") == "nice"
    rows = rows.groupBy("candidate", "position_name").agg(
        F.count_if(must).alias("musts"),
        F.coalesce(F.try_divide(F.sum(F.when(must, F.col("sim"))), F.count_if(must)), F.lit(1.0)).alias("must_score"),
        F.sort_array(F.collect_list(F.when(nice, F.struct("weight", "source_count", "skill", "sim"))), False).alias("nice"),
        F.array_sort(F.collect_list(F.when(must & (F.col("sim") > 0), F.col("skill")))).alias("matched_must"),
        F.array_sort(F.collect_list(F.when(must & (F.col("sim") == 0), F.col("skill")))).alias("missing_must"),
    )
    weight = lambda s: F.coalesce(s["weight"], F.lit(0.0))
    total = lambda x: F.aggregate("nice", F.lit(0.0), lambda n, s: n + x(s))  # noqa: E731; as in _total
    return rows.withColumn("nice_score", F.coalesce(F.try_divide(total(lambda s: s["sim"] * weight(s)), total(weight)), F.lit(1.0))).drop("nice")


def scores(candidates: DataFrame, years: DataFrame, positions: DataFrame, meta: DataFrame, chosen: DataFrame | None = None, weights: dict[str, float] | None = None, near: DataFrame | None = None) -> DataFrame:
    """Must, nice and experience scores and their total for chosen pairs ``candidate, position_name``, or else for all pairs with a common skill.

    ``years``: ``candidate, total_years``; ``meta``: ``position_name, required_years, staleness``; ``near``: ``skill, other, sim`` of
    similar skills, used where a candidate lacks the skill itself. A pair without any must skill matched is unqualified, total 0.
    """
    w = weights or V.MATCH_WEIGHTS
    skills, tasks = _few_skills(positions), 1
    if skills is not None:
        tasks = _tasks(candidates, positions if chosen is None else None)
        candidates = candidates.repartition(tasks, "candidate")
    owned = candidates.groupBy("candidate", "skill").agg(F.max(F.when(F.col("low_confidence"), 0.5).otherwise(1.0)).alias("sim")).withColumn("own", F.lit(True))
    if near is not None:
        soft = owned.join(near.select(F.col("other").alias("skill"), F.col("skill").alias("want"), F.col("sim").alias("_s")), "skill").groupBy("candidate", F.col("want").alias("skill")).agg(F.max(F.col("_s") * F.col("sim")).alias("soft"))
        owned = owned.join(soft, ["candidate", "skill"], "full").select("candidate", "skill", F.coalesce("sim", "soft").alias("sim"), "own")
    if skills is not None:
        rows = _in_rows(owned, years, positions, meta, chosen, skills, tasks)
    else:
        rows = _by_joins(owned, positions, _hits(candidates, positions) if chosen is None else chosen).join(years, "candidate", "left").join(meta, "position_name", "left")
    exp = F.when(F.coalesce("required_years", F.lit(0.0)) <= 0, 1.0).otherwise(F.least(F.coalesce("total_years", F.lit(0.0)) / F.col("required_years"), F.lit(1.0)))
    rows = rows.withColumn("exp_score", exp).withColumn("unqualified", (F.col("musts") > 0) & (F.col("must_score") == 0)).drop("musts")
    total = F.when(F.col("unqualified"), 0.0).otherwise((F.col("must_score") * w["must"] + F.col("nice_score") * w["nice"] + F.col("exp_score") * w["exp"]) * F.coalesce("staleness", F.lit(1.0)))
    return rows.withColumn("total_score", total).drop("total_years", "required_years", "staleness")


def top_matches(scored: DataFrame, n: int) -> DataFrame:
    """The ``n`` best qualified positions of each candidate."""
    w = Window.partitionBy("candidate").orderBy(F.desc("total_score"), "position_name")
    return scored.where("not unqualified").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def gaps(candidates: DataFrame, positions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Each required skill as missing, weak or matched, with its priority."""
    least = F.when(F.col("proficiency") == "初级", 1).when(F.col("proficiency") == "中级", 2).when(F.col("proficiency").isin("高级", "专家"), 3)
    owned = candidates.groupBy("candidate", "skill").agg(F.max("proficiency").alias("has"))
    rows = chosen.select("candidate", "position_name").join(positions, "position_name").join(owned, ["candidate", "skill"], "left")
    kind = F.when(F.col("has").isNull(), "missing").when(F.col("has") < least, "weak").otherwise("matched")
    must = F.col("necessity") == "must"
    priority = F.when(F.col("gap") == "missing", F.when(must, "high").otherwise("medium")).when(F.col("gap") == "weak", F.when(must, "medium").otherwise("low")).otherwise("low")
    return rows.withColumn("gap", kind).withColumn("priority", priority).drop("has")


def learning_path(gap_rows: DataFrame, hours: DataFrame, n: int = 5, default: float = 30.0) -> DataFrame:
    """The first ``n`` missing or weak skills by weight and gap, and their hours. ``hours``: ``skill, hours``."""
    order = F.when(F.col("gap") == "missing", 0).otherwise(1)
    w = Window.partitionBy("candidate", "position_name").orderBy(F.desc("weight"), order, "skill")
    first = gap_rows.where("gap <> 'matched'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return first.join(hours, "skill", "left").withColumn("hours", F.coalesce("hours", F.lit(default)))


def ranked_courses(courses: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` best courses of each skill, those without a score last. ``courses``: ``skill, course, score``."""
    w = Window.partitionBy("skill").orderBy(F.desc_nulls_last("score"), "course")
    return courses.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def courses_of_skills(skills: DataFrame, by_id: DataFrame, by_name: DataFrame) -> DataFrame:
    """Courses by a skill's id or name: two equi-joins and not one with an or. ``skills``: ``skill_id, skill``."""
    a = skills.join(by_id, "skill_id").select("skill", "course", "score")
    return a.unionByName(skills.join(by_name, "skill").select("skill", "course", "score")).distinct()


def project_score(projects: DataFrame, scenarios: DataFrame, chosen: DataFrame) -> DataFrame:
    """Mean cosine of a candidate's projects with a position's scenarios, for chosen pairs ``candidate, position_name``.

    ``projects``: ``candidate, vector``; ``scenarios``: ``position_name, vector``. The mean of pairwise cosines is the product of two mean unit
    vectors, so no pairs of projects and scenarios are made, and both sides are joined by their keys.
    """
    def mean_unit(rows: DataFrame, key: str) -> DataFrame:
        unit = rows.select(key, F.posexplode(F.transform("vector", lambda x: F.coalesce(F.try_divide(x.cast("double"), F.sqrt(S.dot(F.col("vector"), F.col("vector")))), F.lit(0.0)))).alias("i", "x"))
        return unit.groupBy(key, "i").agg(F.avg("x").alias("x")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))

    a, b = mean_unit(projects, "candidate").withColumnRenamed("v", "va"), mean_unit(scenarios, "position_name").withColumnRenamed("v", "vb")
    return chosen.select("candidate", "position_name").join(a, "candidate").join(b, "position_name").select("candidate", "position_name", S.dot(F.col("va"), F.col("vb")).alias("score"))


def radar(scored: DataFrame, education: DataFrame, projects: DataFrame) -> DataFrame:
    """Five dimensions of each pair: must and nice skills, experience, education and projects; unknown ones are 0.

    ``education``: ``candidate, position_name, education_score``; ``projects``: of ``project_score``.
    """
    rows = scored.select("candidate", "position_name", "must_score", "nice_score", "exp_score").join(education, ["candidate", "position_name"], "left").join(projects.withColumnRenamed("score", "project_score"), ["candidate", "position_name"], "left")
    return rows.select("candidate", "position_name", "must_score", "nice_score", "exp_score", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("education_score", "project_score")])
