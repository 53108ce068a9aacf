"""Named queries over nested records and listings, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweft.functions import text as X
from skillweft.functions import vocab as V
from skillweft.operators import ingest, records
from skillweft.plans.quality_queries import requires_edges
from skillweft.plans.quality_queries import _A8 as A8
from skillweft.plans.views import jd, jd_skill, table, with_views


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    """Ads with nested extractions; ads with an even id have no requirements."""
    s = jd_skill(spark, sf)
    reqs = F.array_sort(F.collect_list(F.when(F.col("id") % 2 == 1, F.struct(F.col("skill").alias("skill_name"), "necessity", "level"))))
    own = F.array_sort(F.collect_list(F.struct(F.col("skill").alias("name"))))
    return s.groupBy("id", "position_name", "source").agg(F.struct(F.col("position_name").alias("position_name"), reqs.alias("requirements"), own.alias("skills")).alias("extraction"))


def skill_lists(spark: SparkSession, sf: str) -> DataFrame:
    """J1, J2."""
    return _nested(spark, sf).select("id", F.array_join(records.skills_of(F.col("extraction")), ",").alias("skills"))


def skill_triples(spark: SparkSession, sf: str) -> DataFrame:
    """J3."""
    return records.position_skills(_nested(spark, sf).select("id", "extraction"), "extraction")


def source_skills(spark: SparkSession, sf: str) -> DataFrame:
    """Parts are courses, papers or ads by their type."""
    p = table(spark, sf, "part")
    source = F.when(F.col("p_type") == F.lit("ECONOMY"), "coursera").when(F.col("p_type") == F.lit("LARGE"), "github").otherwise("boss")
    s = records.source_skills(source, X.split_skills(F.concat_ws(",", "p_brand", "p_type")), F.array("p_brand"), F.lit("en"), F.split("p_name", " "), F.array("p_name", F.lit("")))
    return p.select("p_partkey", F.array_join(s, ",").alias("skills"))


def field_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Names of some nations are edited."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    new = n.where("n_nationkey % 3 = 0").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).alias("n_name"))
    return records.merged_fields(n, new, "n_nationkey")


def resume_rules(spark: SparkSession, sf: str) -> DataFrame:
    """skills and years of conversations."""
    r = records.resume_rules(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", F.array_join(F.array_sort("r.skills"), ",").alias("skills"), "r.education_level", "r.total_years")


def owner_files(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of the customer with the most, with their dates."""
    o = table(spark, sf, "orders")
    files = o.select("o_orderkey", "o_custkey")
    cache = o.select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return records.owned(files, cache, "o_orderkey", "o_custkey", 7, "day")


def quality_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their labels by id and source."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    q = d.join(table(spark, sf, "labels"), "doc_id").select("doc_id", "source", "quality")
    return records.with_quality(d, q, ["doc_id", "source"]).withColumn("quality", F.coalesce("quality", F.lit(-1)))


def position_detail(spark: SparkSession, sf: str) -> DataFrame:
    """N23."""
    d = records.position_detail(requires_edges(spark, sf))
    return d.select("position_name", F.array_join("must", ",").alias("must"), F.array_join("nice", ",").alias("nice"))


def skill_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """N24."""
    e = jd_skill(spark, sf).select("skill", F.col("id").alias("ref"), F.date_format("publish_date", "yyyy-MM-dd").alias("crawled_at")).distinct()
    return records.skill_evidence(e, "Brand#11")


def order_page(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of open orders, and how many there are."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"))
    rows, n = records.page(o, [F.desc("at"), "o_orderkey"], 3, 20, F.col("o_orderstatus") == "O")
    return rows.withColumn("total", F.lit(n).cast("long"))


def ad_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that vectors are made from."""
    j = jd(spark, sf)
    return j.select("id", records.ad_text(F.col("position_name"), F.col("company").cast("string"), F.lit("")).alias("ad"), records.project_text(F.col("source"), F.when(F.col("id") % 2 == 0, F.col("position_name"))).alias("project"), X.document_text(F.lit(" "), F.when(F.col("id") % 3 == 0, F.col("source")), F.lit("raw"), F.col("position_name")).alias("body"))


def _letters(text: Column) -> Column:
    """A model for tests: a text's length and how often four letters stand in it."""
    return F.array(*[c.cast("float") for c in (F.length(text), *[F.length(text) - F.length(F.replace(text, F.lit(x), F.lit(""))) for x in "aeio"])])


def embedding_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of part names by a plugged-in model and by the default one; those of one type are there already."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), "p_type")
    done = p.where("p_type = 'ECONOMY'").select("id", F.array(F.lit(1.0).cast("float")).alias("vector"))
    hashed = records.backfilled(p, done, "id", "text").select("id", F.size("vector").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 4).alias("norm"))
    return records.backfilled(p, done, "id", "text", _letters).select("id", F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ",").alias("letters")).join(hashed, "id")


def graph_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """The last non-empty name of every customer's segment after an update with blanks."""
    from skillweft.operators import graph

    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise("").alias("name"), F.col("c_custkey").alias("t"))
    return graph.merged_vertices(c, "id", F.col("t"), ["name"])


def occupation_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Nations of region 0 replace those with their keys."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    new = table(spark, sf, "nation").where("n_regionkey = 0").select("n_nationkey", F.lower("n_name").alias("n_name"))
    return ingest.upsert(n, new, ["n_nationkey"])


QUERIES = {f.__name__: f for f in (skill_lists, skill_triples, source_skills, field_merge, resume_rules, owner_files, quality_lookup, position_detail, skill_evidence, order_page, ad_texts, embedding_backfill, graph_upserts, occupation_upsert)}

_N = with_views("jd", "jd_skill")
ORACLES = {
    "skill_lists": _N[:-2] + " SELECT id, CASE WHEN id % 2 = 1 THEN string_agg(skill, ',' ORDER BY skill, necessity, level) ELSE string_agg(skill, ',' ORDER BY skill) END AS skills FROM jd_skill GROUP BY id",
    "skill_triples": _N[:-2] + " SELECT id, skill, CASE WHEN id % 2 = 1 THEN necessity ELSE 'nice' END AS necessity, CASE WHEN id % 2 = 1 THEN level ELSE '' END AS level FROM jd_skill",
    "source_skills": "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN p_brand || ',' || p_type WHEN 'LARGE' THEN p_brand || ',en,' || replace(p_name, ' ', ',') ELSE p_name END AS skills FROM part",
    "field_merge": "SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 0 THEN lower(n_name) ELSE n_name END AS n_name FROM nation",
    "resume_rules": "SELECT conv_id, turn, coalesce(array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{t.lower()}') THEN '{v}' END" for t, v in [*((w, w) for w in V.SKILL_WHITELIST), *V.SKILL_ALIASES.items()]) + "], lambda x: x IS NOT NULL))), ','), '') AS skills, '' AS education_level, 0.0::DOUBLE AS total_years FROM conversations",
    "owner_files": "SELECT o_orderkey, o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_custkey = 7",
    "quality_lookup": "SELECT doc_id, source, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)",
    "position_detail": A8 + ", m AS (SELECT position_name, skill, CASE WHEN jd_count >= 3 THEN must / jd_count > 0.5 ELSE must / hits >= 0.5 END AS m FROM agg JOIN st USING (position_name)) SELECT position_name, coalesce(string_agg(skill, ',' ORDER BY skill) FILTER (m), '') AS must, coalesce(string_agg(skill, ',' ORDER BY skill) FILTER (NOT m), '') AS nice FROM m GROUP BY ALL",
    "skill_evidence": _N[:-2] + " SELECT DISTINCT skill, id AS ref, strftime(publish_date, '%Y-%m-%d') AS crawled_at FROM jd_skill WHERE skill = 'Brand#11'",
    "order_page": "SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY 3 DESC, o_orderkey LIMIT 20 OFFSET 40",
    "ad_texts": with_views("jd")[:-2] + " SELECT id, position_name || ' ' || company AS ad, source || CASE WHEN id % 2 = 0 THEN '：' || position_name ELSE '' END AS project, CASE WHEN id % 3 = 0 THEN position_name || chr(10) || source ELSE 'raw' END AS body FROM jd",
    "embedding_backfill": "SELECT p_partkey AS id, CAST(CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 384 END AS INT) AS dim, 1.0::DOUBLE AS norm, CASE WHEN p_type = 'ECONOMY' THEN '1' ELSE length(p_name)" + "".join(f" || ',' || (length(p_name) - length(replace(p_name, '{x}', '')))" for x in "aeio") + " END AS letters FROM part",
    "graph_upserts": "SELECT c_nationkey AS id, arg_max(c_name, c_custkey) FILTER (c_custkey % 3 <> 0) AS name FROM customer GROUP BY ALL",
    "occupation_upsert": "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN lower(n_name) ELSE n_name END AS n_name FROM nation",
}
