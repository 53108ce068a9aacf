"""Named queries over parsed values, readers, sinks and guards, with their SQL.

Texts are made from the tables' numbers in all the forms that an operator knows; the SQL states what each form means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweft.functions import positions
from skillweft.functions import scores as S
from skillweft.functions import text as X
from skillweft.functions import vocab as V
from skillweft.operators import discovery, evaluation, graph, ingest, matching, quality, records, running, similarity, substring
from skillweft.plans.graph_queries import both_names
from skillweft.plans.views import jd, jd_skill, table, with_views
from skillweft.sources import readers
from skillweft.sources.staging import shared_path, small


def _form(key: Column, forms: list) -> Column:
    """One of several texts, by the remainder of a key."""
    n = F.pmod(key.cast("long"), F.lit(len(forms)))
    out = F.when(n == 0, forms[0] if isinstance(forms[0], Column) else F.lit(forms[0]))
    for i, f in enumerate(forms[1:], 1):
        out = out.when(n == i, f if isinstance(f, Column) else F.lit(f))
    return out


def _case(key: str, values: list) -> str:
    """The same choice in SQL; Python values become literals, SQL ones are given as they are in a tuple."""

    def literal(v: object) -> str:
        if isinstance(v, tuple):
            return v[0]
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {literal(v)}" for i, v in enumerate(values)) + " END"


def _part(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("n"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))


def _joined(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


# cleaning

TITLES = [("Java开发工程师", None, None), ("Java实习生", "intern", None), ("兼职设计师", "part-time", None), ("Software Intern", "intern", None), ("Part-time Nurse", "part-time", None), ("Internal Auditor", None, None), ("Java/Python/Go", None, "aggregated"), ("高薪急招", None, "aggregated"), ("Java/Python/Go 工程师", None, None), ("", None, None)]


def employment_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why titles are dropped; every third part is tagged as an internship."""
    p = _part(spark, sf).withColumn("title", _form(F.col("id"), [t[0] for t in TITLES])).withColumn("tags", F.when(F.col("id") % 3 == 0, F.array(F.lit("remote"), F.lit("intern"))))
    return p.select("id", X.employment_reason(F.col("title"), F.col("tags")).alias("employment"), X.invalid_job_reason(F.col("title")).alias("invalid"))


def employment_purge(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of rows and of their evidence."""
    p = _part(spark, sf).select("id", F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), _form(F.col("id"), [t[0] for t in TITLES]).alias("title"), F.array().cast("array<string>").alias("tags"))
    rows, evidence = ingest.without_employment(p, p.select("url", "id"))
    return rows.join(evidence.select(F.col("id").alias("e")), F.col("id") == F.col("e"), "left").select("id", F.col("e").isNotNull().alias("has_evidence"))


def trimmed_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Trimmed names of at least ten characters."""
    p = _part(spark, sf).withColumn("name", F.concat(F.lit(" \t"), F.col("name"), F.lit(" \n")))
    return ingest.extractable(ingest.trimmed(p, "name"), "name").select("id", "name")


def invalid_positions(spark: SparkSession, sf: str) -> DataFrame:
    """C11: parts that stand for polluted names."""
    p = _part(spark, sf).withColumn("standard", _form(F.col("id"), ["算法工程师", *V.POLLUTED_POSITIONS]))
    return records.invalid_positions(p, "standard").select("id", "standard")


def rename_plan(spark: SparkSession, sf: str) -> DataFrame:
    """C17: names with a level word, and whether the new one is taken."""
    names = _part(spark, sf).select(F.concat(_form(F.col("id"), ["高级", "资深", ""]), F.col("name")).alias("name")).distinct()
    return ingest.rename_plan(names, "name")


# names and skills

RAW_SKILLS = [(" golang ", "Go"), ("JS", "JavaScript"), ("spring", "Spring Boot"), ("Vue", "Vue.js"), ("PYTHON", "Python"), ("k8s", "Kubernetes"), ("大模型", "大语言模型"), ("Foo", "Foo"), ("微服务框架", "微服务框架"), ("项目管理", "项目管理")]
CLEAN_SKILLS = [("前端开发", "前端"), ("项目管理", "项目管理"), ("软件工程师", "软件"), ("消息中间件", "消息"), ("Python", "Python"), ("Spark框架", "Spark"), ("数据平台", "数据")]
VALID_SKILLS = [("C", True), ("x", False), ("金融", False), ("Go", True), ("五险", False), ("R", True), ("Kafka", True)]
CANONICAL = [("K8S", "kubernetes"), ("Spark框架", "spark"), ("spark", "apache spark"), (" Redis ", "redis"), ("项目管理", "项目管理")]
NOISE = [("MySQL/Redis", True), ("123", True), ("测试", True), ("算法工程师", True), ("熟悉Linux", True), ("五险", True), ("Rust", False), ("Apache Kafka", False), ("x", True)]


def skill_names(spark: SparkSession, sf: str) -> DataFrame:
    """standard, clean, canonical and valid names, and noise."""
    p, of = _part(spark, sf), lambda table_: _form(F.col("id"), [t for t, _ in table_])
    return p.select("id", X.skill_alias(of(RAW_SKILLS)).alias("alias"), X.clean_skill(of(CLEAN_SKILLS)).alias("clean"), X.canonical_skill(of(CANONICAL)).alias("canonical"), X.valid_skill(of(VALID_SKILLS)).alias("valid"), X.noise(of(NOISE)).alias("noise"))


def skill_clean(spark: SparkSession, sf: str) -> DataFrame:
    """F8: cleaned valid skills of each brand, the first of each."""
    s = _part(spark, sf).select(F.col("brand").alias("key"), F.col("id").alias("seq"), _form(F.col("id"), [t for t, _ in RAW_SKILLS[:8]]).alias("name"))
    return ingest.post_processed(s, "key").select("key", "name")


def resume_skill_filter(spark: SparkSession, sf: str) -> DataFrame:
    """brands' skills, marked if they are off the whitelist, and soft ones that aren't named."""
    p = _part(spark, sf)
    skills = p.select(F.col("brand").alias("key"), F.col("id").alias("seq"), _form(F.col("id"), ["python", "金融", "Foo", "沟通能力"]).alias("name"), F.lit(3).alias("proficiency"))
    soft = p.select(F.col("brand").alias("key"), _form(F.col("id"), ["领导力", "bravery", "沟通能力"]).alias("name"))
    return records.resume_skills(skills, soft, "key").select("key", "name", "unmapped", "low_confidence")


GOLDEN = [("Python 算法工程师（CV 方向）", "Python 算法工程师"), ("Java/Python/C/测试岗", "软件开发工程师"), ("a   b", "a b"), ("资深全栈开发工程师（Python/Vue）", "资深全栈开发工程师"), ("前端 (远程)", "前端")]


def golden_rules(spark: SparkSession, sf: str) -> DataFrame:
    """titles and tags of golden sets."""
    p = _part(spark, sf)
    tags = F.array(F.lit("Django"), F.lit("5天/周"), F.lit("本科"), F.lit("django"), F.col("brand"), F.lit("22"))
    return p.select("id", records.golden_title(_form(F.col("id"), [t for t, _ in GOLDEN])).alias("title"), records.golden_category(_form(F.col("id"), [t for t, _ in GOLDEN])).alias("category"), F.array_join(records.golden_skills(tags), ",").alias("tags"))


def skill_migration(spark: SparkSession, sf: str) -> DataFrame:
    """Names moved to their clean form; a fragment becomes the word in the ad."""
    return _part(spark, sf).select("id", records.remapped(_form(F.col("id"), ["微", "微", "前端开发"]), _form(F.col("id"), ["懂微服务", "x", ""])).alias("name"))


def prof_edu(spark: SparkSession, sf: str) -> DataFrame:
    """F10, F29."""
    p = _part(spark, sf)
    return p.select("id", X.proficiency(_form(F.col("id"), ["精通 Java", "熟练使用", "了解", "中级", "none"])).alias("proficiency"), X.education_score(_form(F.col("id"), ["本科", "硕士", "大专", "不限"]), _form(F.col("n"), ["博士", "本科及以上", "高中", ""])).alias("education"))


# numbers, dates and salaries


def salaries(spark: SparkSession, sf: str) -> DataFrame:
    """monthly salaries of all forms."""
    n = F.col("n")
    forms = [_joined(n, "-", n + 10, "K·13薪"), _joined(n, "-", n + 1, "万"), _joined(n * 10, "-", n * 10 + 50, "元/天"), _joined("USD ", n * 1000, "-", n * 1200), _joined("$", n, ",000 - $", n + 5, ",000/year"), _joined("up to ", n, "k"), _joined("Up to $", n, "k"), _joined("up to $", n, "/hour"), F.lit("面议"), _joined("$", n, "/hour")]
    source = F.when(F.col("id") % 20 >= 10, "indeed").otherwise("boss")
    return _part(spark, sf).select("id", F.round(X.monthly_salary(_form(F.col("id"), forms), source), 2).alias("salary"))


def experience(spark: SparkSession, sf: str) -> DataFrame:
    """least years and ranges."""
    n = F.col("n")
    t = _form(F.col("id"), [_joined(n, "-", n + 2, "年"), _joined(n, "年以上"), F.lit("不限"), F.lit("x")])
    r = X.experience_range(t)
    return _part(spark, sf).select("id", X.min_years(t).cast("long").alias("years"), r["min"].cast("long").alias("low"), r["max"].cast("long").alias("high"))


def durations(spark: SparkSession, sf: str) -> DataFrame:
    """hours."""
    n = F.col("n")
    return _part(spark, sf).select("id", X.duration_hours(_form(F.col("id"), [_joined(n, "小时"), _joined(n, " weeks"), _joined(n, "天"), _joined("about ", n, " months"), _joined(n, ".5 h"), _joined(n, "个月"), F.lit("soon")])).alias("hours"))


def dates(spark: SparkSession, sf: str) -> DataFrame:
    """A posting's date in four forms, or else the crawl's."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    post = _form(F.col("id"), [F.date_format("d", "yyyy-MM-dd"), F.date_format("d", "yyyy/MM/dd"), F.date_format("d", "yyyy.MM.dd"), F.date_format("d", "yyyyMMdd"), F.lit("yesterday"), F.lit(None).cast("string")])
    return o.select("id", X.publish_date(post, F.when(F.col("id") % 12 != 11, F.date_format(F.date_add("d", 3), "yyyy-MM-dd'T'HH:mm:ss"))).alias("published"))


def instants(spark: SparkSession, sf: str) -> DataFrame:
    """seconds of timestamps with Z, with an offset, with none, and of no timestamp."""
    t = lambda f: F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss" + f)
    return table(spark, sf, "events").select("event_id", F.unix_timestamp(X.instant(_form(F.col("event_id"), [t("'Z'"), t("'+08:00'"), t(""), F.lit("soon")]))).alias("seconds"))


def score_parts(spark: SparkSession, sf: str) -> DataFrame:
    """F22, F23, F24, F25, F26."""
    p = _part(spark, sf)
    z = S.zscore(F.col("n").cast("double"), F.lit(20.0), F.when(F.col("id") % 5 == 0, 0.0).otherwise(8.0))
    return p.select("id", F.round(z, 6).alias("z"), F.round(S.growth(F.col("n").cast("double"), (F.col("id") % 4).cast("double")), 6).alias("growth"), S.trend(z, F.col("n")).alias("trend"), F.round(S.z_confidence(z), 6).alias("confidence"), F.round(S.share_of(F.col("n") - 10.0, 25.0), 6).alias("share"))


def cosines(spark: SparkSession, sf: str) -> DataFrame:
    """of neighbours in id."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    w = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(w, "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def weights(spark: SparkSession, sf: str) -> DataFrame:
    """configured weights of every part as JSON, or else the defaults: some lack one, have a text or a negative number, or are no JSON."""
    n = (F.col("p_size") / 10.0).cast("string")
    parts = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    config = _form(F.col("p_partkey"), [parts('{"must": ', n, ', "nice": 2, "exp": "0.5", "more": 9}'), parts('{"must": ', n, "}"), parts('{"must": "x", "nice": ', n, ', "exp": 3}'), parts('{"must": -', n, ', "nice": 2, "exp": 3}'), parts("none ", n)])
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), evaluation.configured_weights(config, V.MATCH_WEIGHTS).alias("w")).select("id", *[F.col(f"w.{k}").alias(k) for k in ("must", "nice", "exp")])


# readers and sinks


def golden_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Labels written as JSON lines, with lines that are none, and read back."""
    path = shared_path(spark, "golden")
    table(spark, sf, "labels").select(F.when(F.col("doc_id") % 10 == 0, "no object").otherwise(F.to_json(F.struct("doc_id", "quality"))).alias("value")).write.text(path)
    return readers.golden_set(spark, path, "doc_id long, quality int")


def occupation_table(spark: SparkSession, sf: str) -> DataFrame:
    """Nations written as a CSV table of occupations, with blank codes and comments."""
    path = shared_path(spark, "occupations")
    n = table(spark, sf, "nation")
    code = F.when(F.col("n_nationkey") % 7 == 3, " ").otherwise(F.concat((10 + F.col("n_regionkey") * 10).cast("string"), F.lit("-"), F.col("n_nationkey").cast("string")))
    n.select(code.alias("code"), F.col("n_name").alias("name"), F.lit("d").alias("definition"), F.concat(F.lit(" a ;;b; a;"), F.col("n_name")).alias("aliases")).write.option("header", True).csv(path)
    return readers.occupations(spark, path).select("code", "name", "category", F.array_join("aliases", ",").alias("aliases"))


def record_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Stored records after a key, a page in the key's order."""
    rows = readers.records(spark, f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return rows.where("id > 100").orderBy("id").limit(50)


def report_sink(spark: SparkSession, sf: str) -> DataFrame:
    """A day's report, written twice and read back."""
    path = shared_path(spark, "report")
    report = quality.source_distribution(table(spark, sf, "documents"))
    for _ in range(2):
        readers.write_report(report, path, "2024-01-31")
    return spark.read.schema("source string, cnt long").json(f"{path}/day=2024-01-31")


def graph_export(spark: SparkSession, sf: str) -> DataFrame:
    """Vertices outside internal labels, named by their id if need be."""
    p = table(spark, sf, "part")
    v = p.select(F.when(F.col("p_partkey") % 11 != 0, F.concat(F.lit("v"), F.col("p_partkey").cast("string"))).alias("id"), F.when(F.col("p_size") > 5, F.col("p_name")).otherwise("").alias("name"), F.when(F.col("p_type") == "SMALL", "Counter").otherwise("Skill").alias("label"))
    return graph.exported(v, p.select(F.lit("a").alias("src"), F.lit("b").alias("dst")), ["Counter"])[0]


def position_loader(spark: SparkSession, sf: str) -> DataFrame:
    """Requirements of brands with soft skills and defaults."""
    p = _part(spark, sf)
    edges = p.select(F.col("brand").alias("position_name"), F.col("name").alias("skill"), F.lit("must").alias("necessity"), F.when(F.col("n") > 10, F.col("n") / 10.0).alias("weight"), F.lit(None).cast("string").alias("proficiency"), F.when(F.col("n") > 20, F.col("n").cast("int")).alias("source_count"))
    soft = p.groupBy(F.col("brand").alias("position_name")).agg(F.array(F.lit("沟通能力"), F.lit("领导力")).alias("soft_skills"))
    return matching.position_requirements(edges, soft).groupBy("position_name", "necessity").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"), F.sum("source_count").alias("sources"))


def candidate_loader(spark: SparkSession, sf: str) -> DataFrame:
    """Skills as names or objects."""
    obj = F.to_json(F.struct(F.col("p_brand").alias("name"), (F.col("p_size") % 3 + 1).alias("proficiency"), (F.col("p_size") > 25).alias("low_confidence")))
    parsed = table(spark, sf, "part").select(F.col("p_partkey").alias("candidate"), F.array(obj, F.col("p_name")).alias("skills"))
    return matching.candidate_skills(parsed)


# guards, courses, life cycle


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.format_string("v%06d", "vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def semantic_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Names of one label are the vocabulary; others meet it by their vectors."""
    v = _names(spark, sf)
    vocabulary = v.where("label = 0").select(F.col("id").alias("code"), F.col("id").alias("name"), F.array().cast("array<string>").alias("aliases"))
    return similarity.aligned(v.select(F.col("id").alias("name")), vocabulary, v.select("id", "vector"), 0.3).select("name", "code", F.round("confidence", 6).alias("confidence"))


def skill_courses(spark: SparkSession, sf: str) -> DataFrame:
    """Courses of brands by id or by name."""
    p = _part(spark, sf)
    skills = p.groupBy(F.col("brand").alias("skill")).agg(F.min("id").alias("skill_id"))
    course = lambda k: p.select(k, F.col("id").alias("course"), F.col("n").cast("double").alias("score"))
    return matching.courses_of_skills(skills, course((F.col("n") % 30).cast("long").alias("skill_id")), course(F.col("brand").alias("skill"))).select("skill", "course")


def radar(spark: SparkSession, sf: str) -> DataFrame:
    """Projects of users' labels against scenarios of the same and the next label."""
    v = table(spark, sf, "embeddings")
    projects, scenarios = v.select(F.col("label").alias("candidate"), F.col("embedding").alias("vector")), v.select((F.col("label") + 100).alias("position_name"), F.col("embedding").alias("vector"))
    labels = v.select("label").distinct()
    chosen = labels.select(F.col("label").alias("candidate"), F.explode(F.array(F.col("label") + 100, (F.col("label") + 1) % 10 + 100)).alias("position_name"))
    scored = chosen.select("candidate", "position_name", F.lit(0.5).alias("must_score"), F.lit(0.25).alias("nice_score"), F.lit(1.0).alias("exp_score"))
    education = chosen.where("candidate < 5").select("candidate", "position_name", F.lit(0.5).alias("education_score"))
    r = matching.radar(scored, education, matching.project_score(projects, scenarios, chosen))
    return r.select("candidate", "position_name", "must_score", "nice_score", "exp_score", "education_score", F.round("project_score", 6).alias("project_score"))


def candidate_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """New candidates against old states."""
    c = table(spark, sf, "customer")
    old = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("position_name"), _form(F.col("c_nationkey"), ["candidate", "stable", "rejected"]).alias("state"), F.lit(0.5).alias("confidence"), F.lit(None).cast("double").alias("jd_freq_ma3"))
    new = c.where("c_acctbal < 5000").select(F.col("c_custkey").alias("position_name"), F.lit("candidate").alias("state"), F.lit(0.75).alias("confidence"), F.col("c_acctbal").alias("jd_freq_ma3"))
    return discovery.upserted(old, new)


def grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Positions in both languages with their seed, entry and draft; entries hold a name anywhere, or an alias does."""
    seeds = spark.createDataFrame([(1, "build", ["BUILDING"], "builds"), (2, "house", ["HOUSEHOLD"], "keeps"), (3, "算法", ["算法工程师"], "写算法")], "seed_order int, seed string, terms array<string>, description string")
    n = table(spark, sf, "nation")
    plain = n.select(F.col("n_nationkey").alias("code"), F.concat(F.lit("machinery/"), F.lower("n_name"), F.lit(" and more")).alias("name"), F.concat(F.lit("of "), F.col("n_name")).alias("definition"), F.array(F.concat(F.lit("资深高级"), F.element_at(F.array(*map(F.lit, ("前端", "算法", "数据"))), F.col("n_nationkey") % 3 + 1), F.lit("工程师专家"))).alias("aliases"))
    whole = n.select((F.col("n_nationkey") + 100).alias("code"), F.concat(F.lit("首席云计算"), F.element_at(F.array(*map(F.lit, ("测试", "产品"))), F.col("n_nationkey") % 2 + 1), F.lit("工程师组")).alias("name"), F.lit(None).cast("string").alias("definition"), F.array(F.concat(F.lit("BUILDING/"), F.col("n_name"))).alias("aliases"))
    return discovery.grounded(both_names(spark, sf), seeds, plain.unionByName(whole))


def edge_migration(spark: SparkSession, sf: str) -> DataFrame:
    """One edge type under another's name."""
    e = table(spark, sf, "part").select(F.col("p_brand").alias("src"), F.col("p_name").alias("dst"), F.col("p_type").alias("type"))
    return graph.relabelled(e, "SMALL", "LARGE").groupBy("type").agg(F.count("*").alias("n"))


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    """Ads as extractions: some without a position, some without skills."""
    s = jd_skill(spark, sf).groupBy("id", "position_name").agg(F.collect_set("skill").alias("skills"))
    return s.select("id", F.when(F.col("id") % 13 == 0, " ").otherwise(F.col("position_name")).alias("position_name"), F.when(F.col("id") % 17 != 0, F.col("skills")).alias("skills"))


def graph_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """Vertices and edges replayed from all extractions."""
    v, e = graph.rebuilt(_extracted(spark, sf))
    return v.select("id", "label", "name").unionByName(e.select(F.col("src").alias("id"), F.lit("edge").alias("label"), F.col("dst").alias("name")))


def soft_skill_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Soft skills of positions by how many ads name them; the rank comes from count and name."""
    soft = F.array(_form(F.col("id"), ["沟通能力", "领导力", "bravery"]), _form(F.col("id"), ["责任心", "沟通能力"]))
    counts = quality.soft_skills(jd(spark, sf).select("id", "position_name", soft.alias("soft_skills")))
    ranked = quality.ranked_soft_skills(counts).select("position_name", F.array_join("soft_skills", ",").alias("listed"))
    return counts.join(ranked, "position_name")


def _halving_sql() -> str:
    """The rungs one after the other: 54 points on an 81st of the rows, then 18, 6, 2 and 1 on three times as many each."""
    with_ = "WITH d AS (SELECT doc_id, length(text) AS n, quality = 1 AS gold, substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS h FROM labels JOIN documents USING (doc_id)), p0 AS (SELECT unnest([" + ", ".join(f"{x}::DOUBLE" for x in SEARCHED) + "]) AS least)"
    kept, rungs = 54, 4
    for r in range(rungs + 1):
        some = "" if r == rungs else f" AND h < '{2**32 // 3 ** (rungs - r):08x}'"
        kept = -(-kept // 3)
        with_ += f""", c{r} AS (SELECT least, count_if(n > least AND gold) AS tp, count_if(n <= least AND gold) AS fn, count_if(n > least AND NOT gold) AS fp, count_if(n <= least AND NOT gold) AS tn FROM p{r} LEFT JOIN d ON true{some} GROUP BY least),
  o{r} AS (SELECT least, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, coalesce(fp / nullif(fp + tn, 0), 0.0) AS fpr FROM c{r}),
  s{r} AS (SELECT {r} AS rung, *, round(recall - 0.5 * greatest(0.0, fpr - 0.15), 9) AS objective FROM o{r}), r{r} AS (SELECT *, row_number() OVER (ORDER BY objective DESC, fpr, least) AS rank FROM s{r}), p{r + 1} AS (SELECT least FROM r{r} WHERE rank <= {kept})"""
    return with_ + " SELECT CAST(rung AS INT) AS rung, least, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(objective, 6) AS objective, CAST(rank AS INT) AS rank FROM (" + " UNION ALL ".join(f"SELECT * FROM r{r}" for r in range(rungs + 1)) + ")"


SEARCHED = [10.0 + 37.5 * ((31 * i) % 54) for i in range(54)]


def random_search(spark: SparkSession, sf: str) -> DataFrame:
    """All evaluations of a halving search for the length over which a labelled document is good."""
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", F.length("text").alias("n")), "doc_id")
    rows = d.select("doc_id", "n", (F.col("quality") == 1).alias("gold"))
    points = spark.createDataFrame([(x,) for x in SEARCHED], "least double")
    found = evaluation.successive_halving(rows, points, F.col("n") > F.col("least"), "doc_id")
    return found.select("rung", "least", F.round("recall", 6).alias("recall"), F.round("fpr", 6).alias("fpr"), F.round("objective", 6).alias("objective"), "rank")


def whitelist_skills(spark: SparkSession, sf: str) -> DataFrame:
    """Names of a whitelist file in every document; the file lists the long words of all benchmark items."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("w")).distinct()
    path = shared_path(spark, "whitelist")
    words.orderBy("w").coalesce(1).select(F.format_string('- { name: "%s", category: "x" }', "w").alias("value")).write.text(path)
    found = substring.names_in(table(spark, sf, "documents"), "doc_id", "text", [(w, w) for w in readers.whitelist(spark, path)])
    return found.select("doc_id", F.size("names").cast("long").alias("n"), F.array_join("names", ",").alias("names"))


def titles_normalized(spark: SparkSession, sf: str) -> DataFrame:
    """titles of customers in English and Chinese."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), _form(F.col("c_custkey"), JOBS).alias("title"))
    return positions.normalize_positions(c, "title", "standard").select("id", "standard")


def freq_history(spark: SparkSession, sf: str) -> DataFrame:
    """Each ad with how many earlier ads of its position there are, by date and id: running numbers less the position's first."""
    ads = jd(spark, sf).select("id", "position_name", F.struct("position_name", "publish_date", "id").alias("o"))
    n = running.numbered(ads, "o", "k")
    first = n.groupBy("position_name").agg(F.min("k").alias("first"))
    return n.join(small(first), "position_name").select("id", (F.col("k") - F.col("first")).cast("long").alias("earlier"))


JOBS = ["Senior Software Engineer", "Data Analyst, Growth", "Lead Data Scientist (Remote)", "Sr. SRE / Platform", "web前端开发工程师", "React前端开发工程师", "前端开发工程师(Vue)", "前端开发工程师（上海）", "高级量化分析师", "分析师", "信贷分析师主管", "技术", "数据实习生", "", "大数据开发", "厨师", "财务经理", "项目经理助理", "开发工程师", "C++ 开发", "资深小程序开发", "Kafka Streaming Architect", "商业智能分析师", "嵌入式软件工程师", "UI designer, web"]

QUERIES = {
    f.__name__: f
    for f in (employment_reasons, employment_purge, trimmed_fields, invalid_positions, rename_plan, skill_names, skill_clean, resume_skill_filter, golden_rules, skill_migration, prof_edu, salaries, experience, durations, dates, instants, score_parts, cosines, weights, golden_lines, occupation_table, record_pages, report_sink, graph_export, position_loader, candidate_loader, semantic_guard, skill_courses, radar, candidate_upsert, grounding, edge_migration, graph_rebuild, soft_skill_counts, random_search, whitelist_skills, titles_normalized, freq_history)
}


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _families(x: str, rows) -> str:
    return " ".join("WHEN " + " OR ".join(f"contains({x}, '{w.lower()}')" for w in words) + f" THEN '{value}'" for words, value in rows)


def titles_sql(names: str) -> str:
    """F9 in SQL for ``id, name`` rows, from the same tables: English titles, brackets and prefixes, stacks, then families and cores."""
    by_length = sorted(V.EN_POSITIONS.items(), key=lambda kv: -len(kv[0]))
    special = str.maketrans({c: "\\" + c for c in ".+*?()[]{}|^$/"})
    exact = lambda x: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.EN_POSITIONS.items()) + " END"
    longest = "CASE " + " ".join(f"WHEN regexp_matches(low, '(^|[^a-z]){k.translate(special)}($|[^a-z])') THEN '{v}'" for k, v in by_length) + " END"
    stacks = sorted(V.TECH_STACKS, key=lambda t: -len(t[0]))
    begins = lambda what: "CASE " + " ".join(f"WHEN starts_with(lower(bare), '{m}') THEN {what(m, shown)}" for m, shown in stacks) + " END"
    return f"""WITH t AS ({names}),
a AS (SELECT *, trim(lower(name)) AS low, trim(regexp_replace(trim(regexp_replace(name, '[（(].*?[)）]', '', 'g')), '{V.POSITION_PREFIX}', '')) AS bare, trim(regexp_extract(name, '[（(]([^()（）]*)[)）]', 1)) AS inside FROM t),
b AS (SELECT *, coalesce({exact("low")}, {exact("trim(split_part(low, ',', 1))")}, {longest}) AS en, {begins(lambda m, shown: f"'{shown}'")} AS stack, {begins(lambda m, shown: str(len(m)))} AS cut FROM a),
c AS (SELECT *, coalesce(en, trim(substr(bare, coalesce(cut, 0) + 1))) AS base, CASE WHEN en IS NULL THEN coalesce(stack, CASE lower(inside) {" ".join(f"WHEN '{m}' THEN '{shown}'" for m, shown in V.TECH_STACKS)} END, '') ELSE '' END AS tech FROM b),
d AS (SELECT *, regexp_extract(base, '^(.+?)\\s*(?:(?:{positions.suffixes()})\\s*)*$', 1) AS core FROM c),
e AS (SELECT *, CASE {_families("lower(base)", V.POSITION_FAMILIES)} ELSE CASE WHEN ends_with(core, '分析师') THEN CASE {_families("trim(lower(regexp_replace(core, '分析师$', '')))", V.ANALYST_FAMILIES)} ELSE '分析师' END ELSE core END END AS family FROM d)
SELECT id, CASE WHEN contains(coalesce(en, name), '实习') OR family = '' OR family IN ({_quoted(V.POSITION_STOPWORDS)}) THEN '' ELSE tech || family END AS standard FROM e"""


_SEGMENT = "CASE c_mktsegment WHEN 'BUILDING' THEN 'Senior Software Engineer, Platform' WHEN 'MACHINERY' THEN '高级React前端开发工程师' ELSE c_mktsegment END"
_P = "WITH p AS (SELECT p_partkey AS id, p_size AS n, p_name AS name, p_brand AS brand FROM part)"
_YEAR, _HOUR = V.USD_RATE / 12, 8 * V.DAYS_PER_MONTH * V.USD_RATE
_GONE = " OR ".join(f"id % {len(TITLES)} = {i}" for i, t in enumerate(TITLES) if t[1])

ORACLES = {
    "employment_reasons": f"{_P} SELECT id, coalesce({_case('id', [t[1] for t in TITLES])}, CASE WHEN id % 3 = 0 THEN 'intern' END) AS employment, {_case('id', [t[2] for t in TITLES])} AS invalid FROM p",
    "employment_purge": f"{_P} SELECT id, true AS has_evidence FROM p WHERE NOT ({_GONE})",
    "trimmed_fields": f"{_P} SELECT id, name FROM p WHERE length(name) >= 10",
    "invalid_positions": f"{_P} SELECT id, {_case('id', [None, *V.POLLUTED_POSITIONS])} AS standard FROM p WHERE id % {1 + len(V.POLLUTED_POSITIONS)} <> 0",
    "rename_plan": f"{_P}, o AS (SELECT DISTINCT {_case('id', ['高级', '资深', ''])} || name AS old FROM p), r AS (SELECT old, substr(old, 3) AS new FROM o WHERE old LIKE '高级%' OR old LIKE '资深%') SELECT old, new, new IN (SELECT old FROM o) AS conflict FROM r",
    "skill_names": f"{_P} SELECT id, {_case('id', [v for _, v in RAW_SKILLS])} AS alias, {_case('id', [v for _, v in CLEAN_SKILLS])} AS clean, {_case('id', [v for _, v in CANONICAL])} AS canonical, {_case('id', [v for _, v in VALID_SKILLS])} AS valid, {_case('id', [v for _, v in NOISE])} AS noise FROM p",
    "skill_clean": f"{_P} SELECT DISTINCT brand AS key, {_case('id', [v for _, v in RAW_SKILLS[:8]])} AS name FROM p",
    "resume_skill_filter": f"{_P}, own AS (SELECT DISTINCT brand AS key, {_case('id', ['Python', None, 'Foo', '沟通能力'])} AS name FROM p), soft AS (SELECT DISTINCT brand AS key, {_case('id', ['领导力', None, '沟通能力'])} AS name FROM p) SELECT key, name, name = 'Foo' AS unmapped, false AS low_confidence FROM own WHERE name IS NOT NULL UNION ALL SELECT key, name, false, true FROM soft WHERE name IS NOT NULL AND (key, name) NOT IN (SELECT (key, name) FROM own WHERE name IS NOT NULL)",
    "golden_rules": f"{_P} SELECT id, {_case('id', [v for _, v in GOLDEN])} AS title, {_case('id', ['后端', '后端', '其他', '后端', '前端'])} AS category, 'Django,' || brand AS tags FROM p",
    "skill_migration": f"{_P} SELECT id, {_case('id', ['微服务', '微', '前端'])} AS name FROM p",
    "prof_edu": f"{_P} SELECT id, {_case('id', ['高级', '中级', '初级', '中级', None])} AS proficiency, CASE WHEN id % 4 = 3 OR n % 4 = 3 THEN NULL ELSE (CASE (CASE n % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 0 END) - (CASE id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END) WHEN -1 THEN 0.5::DOUBLE WHEN -2 THEN 0.0::DOUBLE WHEN -3 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) END AS education FROM p",
    "salaries": f"{_P} SELECT id, round(CAST(CASE id % 10 WHEN 0 THEN (n + 5) * 1000 WHEN 1 THEN (n + 0.5) * 10000 WHEN 2 THEN (n * 10 + 25) * {V.DAYS_PER_MONTH} WHEN 3 THEN n * 1100 * {_YEAR}::DOUBLE WHEN 4 THEN (n * 1000 + 2500) * {_YEAR}::DOUBLE WHEN 5 THEN n * 1000 * CASE WHEN id % 20 >= 10 THEN {_YEAR}::DOUBLE ELSE 1 END WHEN 6 THEN n * 1000 * {_YEAR}::DOUBLE WHEN 7 THEN n * {_HOUR} WHEN 9 THEN n * {_HOUR} END AS DOUBLE), 2) AS salary FROM p",
    "experience": f"{_P} SELECT id, CASE WHEN id % 4 < 2 THEN n END AS years, CASE id % 4 WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN 0 END AS low, CASE WHEN id % 4 = 0 THEN n + 2 END AS high FROM p",
    "durations": f"{_P} SELECT id, CAST(CASE id % 7 WHEN 0 THEN n WHEN 1 THEN n * 40 WHEN 2 THEN n * 8 WHEN 3 THEN n * 160 WHEN 4 THEN n + 0.5 WHEN 5 THEN n * 160 END AS DOUBLE) AS hours FROM p",
    "dates": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 < 4 THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 12 <> 11 THEN CAST(o_orderdate AS DATE) + 3 END AS published FROM orders",
    "instants": "SELECT event_id, CASE event_id % 4 WHEN 1 THEN CAST(floor(epoch(ts)) AS BIGINT) - 28800 WHEN 3 THEN NULL ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS seconds FROM events",
    "score_parts": f"{_P}, z AS (SELECT *, CASE WHEN id % 5 = 0 THEN 0.0::DOUBLE ELSE (n - 20) / 8.0::DOUBLE END AS z FROM p) SELECT id, round(z, 6) AS z, round(CASE WHEN id % 4 <> 0 THEN (n - id % 4) / CAST(id % 4 AS DOUBLE) END, 6) AS growth, CASE WHEN n < 10 THEN 'protected' WHEN z > 2 THEN 'emerging' WHEN z > 1.5 THEN 'rising' WHEN z < -1.5 THEN 'declining' ELSE 'stable' END AS trend, round(least(abs(z) / 4, 1.0), 6) AS confidence, round(least(greatest(n - 10, 0) / 25.0::DOUBLE, 1.0), 6) AS share FROM z",
    "cosines": "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "weights": "SELECT p_partkey AS id, " + ", ".join(f"CASE WHEN p_partkey % 5 = 0 THEN {v}::DOUBLE ELSE {V.MATCH_WEIGHTS[k]}::DOUBLE END AS {k}" for k, v in (("must", "(p_size / 10.0)"), ("nice", "2"), ("exp", "0.5"))) + " FROM part",
    "golden_lines": "SELECT doc_id, CAST(quality AS INT) AS quality FROM labels WHERE doc_id % 10 <> 0",
    "occupation_table": "SELECT (10 + n_regionkey * 10) || '-' || n_nationkey AS code, n_name AS name, " + "CASE 10 + n_regionkey * 10 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in readers.CATEGORIES.items()) + " ELSE 'other' END AS category, 'a,b,' || n_name AS aliases FROM nation WHERE n_nationkey % 7 <> 3",
    "record_pages": "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50",
    "report_sink": "SELECT coalesce(nullif(trim(source), ''), 'unknown') AS source, count(*) AS cnt FROM documents GROUP BY ALL",
    "graph_export": "SELECT 'v' || p_partkey AS id, CASE WHEN p_size > 5 THEN p_name ELSE 'v' || p_partkey END AS name, 'Skill' AS type FROM part WHERE p_partkey % 11 <> 0 AND p_type <> 'SMALL'",
    "position_loader": f"{_P} SELECT brand AS position_name, 'must' AS necessity, count(*) AS n, round(sum(CASE WHEN n > 10 THEN n / 10 ELSE 1.0 END), 4) AS weight, CAST(sum(CASE WHEN n > 20 THEN n ELSE 1 END) AS BIGINT) AS sources FROM p GROUP BY brand UNION ALL SELECT brand, 'nice', 2, 0.8, 2 FROM p GROUP BY brand",
    "candidate_loader": "SELECT p_partkey AS candidate, p_brand AS skill, CAST(p_size % 3 + 1 AS INT) AS proficiency, p_size > 25 AS low_confidence FROM part UNION ALL SELECT p_partkey, p_name, 2, false FROM part",
    "semantic_guard": "WITH v AS (SELECT printf('v%06d', vec_id) AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), p AS (SELECT x.id AS name, y.id AS code, list_cosine_similarity(x.e, y.e) AS s FROM v x, v y WHERE x.label <> 0 AND y.label = 0), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY s DESC, code) AS k FROM p WHERE s >= 0.3) SELECT id AS name, id AS code, 1.0::DOUBLE AS confidence FROM v WHERE label = 0 UNION ALL SELECT name, code, round(s, 6) FROM r WHERE k = 1",
    "skill_courses": f"{_P}, s AS (SELECT brand AS skill, min(id) AS skill_id FROM p GROUP BY brand) SELECT skill, id AS course FROM s JOIN p ON skill_id = n % 30 UNION SELECT skill, id FROM s JOIN p ON skill = brand",
    "radar": "WITH u AS (SELECT label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS e FROM embeddings), c AS (SELECT DISTINCT label AS a, unnest([label, (label + 1) % 10]) AS b FROM u) SELECT a AS candidate, b + 100 AS position_name, 0.5::DOUBLE AS must_score, 0.25::DOUBLE AS nice_score, 1.0::DOUBLE AS exp_score, CASE WHEN a < 5 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS education_score, round((SELECT avg(list_inner_product(x.e, y.e)) FROM u x, u y WHERE x.label = a AND y.label = b), 6) AS project_score FROM c WHERE b IN (SELECT label FROM u)",
    "candidate_upsert": "WITH c AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN " + _case("c_nationkey", ["candidate", "stable", "rejected"]) + " END AS old, c_acctbal < 5000 AS new, c_acctbal AS b FROM customer) SELECT k AS position_name, CASE WHEN old IS NOT NULL AND (old <> 'candidate' OR NOT new) THEN old ELSE 'candidate' END AS state, CASE WHEN new THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END AS confidence, CASE WHEN new THEN b ELSE 0.0::DOUBLE END AS jd_freq_ma3 FROM c WHERE old IS NOT NULL OR new",
    "grounding": with_views("jd", "chinese") + """e AS (SELECT n_nationkey AS code, 'machinery/' || lower(n_name) || ' and more' AS t, 1.0 AS s FROM nation UNION ALL SELECT n_nationkey, '资深高级' || (['前端', '算法', '数据'])[n_nationkey % 3 + 1] || '工程师专家', 0.5 FROM nation
  UNION ALL SELECT n_nationkey + 100, '首席云计算' || (['测试', '产品'])[n_nationkey % 2 + 1] || '工程师组', 1.0 FROM nation UNION ALL SELECT n_nationkey + 100, 'building/' || lower(n_name), 0.5 FROM nation),
s AS (SELECT name, CASE WHEN contains(lower(name), 'building') THEN 'build' WHEN contains(lower(name), 'household') THEN 'house' WHEN contains(name, '算法工程师') THEN '算法' END AS seed FROM chinese),
h AS (SELECT name, code, row_number() OVER (PARTITION BY name ORDER BY s DESC, code) AS k FROM chinese JOIN e ON contains(t, lower(name)))
SELECT s.name, seed, code, coalesce('of ' || n_name, CASE seed WHEN 'build' THEN 'builds' WHEN 'house' THEN 'keeps' WHEN '算法' THEN '写算法' END) AS draft FROM s LEFT JOIN (SELECT * FROM h WHERE k = 1) h ON h.name = s.name LEFT JOIN nation ON n_nationkey = code""",
    "edge_migration": "SELECT type, count(*) AS n FROM (SELECT DISTINCT p_brand, p_name, CASE p_type WHEN 'SMALL' THEN 'LARGE' ELSE p_type END AS type FROM part) GROUP BY ALL",
    "graph_rebuild": with_views("jd", "jd_skill") + "x AS (SELECT DISTINCT position_name AS p, skill AS s FROM jd_skill WHERE id % 13 <> 0 AND id % 17 <> 0) SELECT DISTINCT 'pos_' || substr(sha1(p), 1, 8) AS id, 'Position' AS label, p AS name FROM x UNION ALL SELECT DISTINCT 'sk_' || substr(sha1(s), 1, 8), 'Skill', s FROM x UNION ALL SELECT 'pos_' || substr(sha1(p), 1, 8), 'edge', 'sk_' || substr(sha1(s), 1, 8) FROM x",
    "soft_skill_counts": with_views("jd") + f"s AS (SELECT position_name, unnest(list_distinct([{_case('id', ['沟通能力', '领导力', None])}, {_case('id', ['责任心', '沟通能力'])}])) AS skill FROM jd), c AS (SELECT position_name, skill, count(*) AS n FROM s WHERE skill IS NOT NULL GROUP BY ALL), l AS (SELECT position_name, string_agg(skill, ',' ORDER BY n DESC, skill) AS listed FROM c GROUP BY ALL) SELECT position_name, skill, n, listed FROM c JOIN l USING (position_name)",
    "random_search": _halving_sql(),
    "whitelist_skills": "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM benchmark), h AS (SELECT doc_id, string_agg(w, ',' ORDER BY w) AS names, count(*) AS n FROM documents JOIN w ON contains(lower(text), w) GROUP BY doc_id) SELECT doc_id, coalesce(n, 0) AS n, coalesce(names, '') AS names FROM documents LEFT JOIN h USING (doc_id)",
    "titles_normalized": titles_sql(f"SELECT c_custkey AS id, {_case('c_custkey', JOBS)} AS name FROM customer"),
    "positions_normalized": "WITH s AS (" + titles_sql(f"SELECT c_custkey AS id, {_SEGMENT} AS name FROM customer") + f") SELECT c_custkey, {_SEGMENT} AS title, standard FROM s JOIN customer ON id = c_custkey",
    "freq_history": with_views("jd")[:-2] + " SELECT id, row_number() OVER (PARTITION BY position_name ORDER BY publish_date, id) - 1 AS earlier FROM jd",
}
