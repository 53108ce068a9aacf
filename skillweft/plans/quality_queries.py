"""Named queries over raw records, their quality and fingerprints, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweft.functions import scores as S
from skillweft.functions import text as X
from skillweft.functions import vocab as V
from skillweft.operators import ingest, quality, running, similarity
from skillweft.plans.views import jd, jd_skill, table, with_views

AS_OF = "2001-08-01"
#: Latin-script names that stand for the skill vocabulary in documents without CJK characters.
SKILL_OTHERS = {"ing ": "gerund", "tion": "ation"}
SKILL_WORDS = ("the", "que", "und", "les", "ation", "Python", "C++")


def _r(name: str, n: int = 6):
    return F.round(name, n).alias(name)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def simhash(spark: SparkSession, sf: str) -> DataFrame:
    """64-bit fingerprints of all documents."""
    return similarity.simhash(_docs(spark, sf), "doc_id", "text")


def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of different fingerprints within 3 bits."""
    return similarity.near_fingerprints(simhash(spark, sf)).select("a", "b", F.col("distance").cast("long").alias("distance"))


def duplicate_mark(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's earliest near-duplicate (-1: none)."""
    return similarity.near_documents(simhash(spark, sf), "doc_id").select("doc_id", F.coalesce("duplicate_of", F.lit(-1)).alias("duplicate_of"))


def duplicate_purge(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of one source that are no later duplicate."""
    marks = duplicate_mark(spark, sf)
    lost = marks.where("duplicate_of >= 0").join(_docs(spark, sf).where("source = 'src0'").select("doc_id"), "doc_id")
    kept, _ = ingest.purge(_docs(spark, sf).select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("url")), spark.createDataFrame([], "url string"), lost.select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("url")))
    return kept.select("id")


def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """similarity of the skill sets of an ad's must and nice lines."""
    s = jd_skill(spark, sf).groupBy("id").agg(F.collect_set(F.when(F.col("necessity") == "must", F.col("skill"))).alias("a"), F.collect_set(F.when(F.col("necessity") == "nice", F.col("skill"))).alias("b"))
    return s.select("id", F.round(S.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """C4."""
    return _docs(spark, sf).select("doc_id", X.fingerprint(F.col("source"), F.col("doc_id").cast("string")).alias("fingerprint"))


def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    """Without the format part, which needs back-references."""
    q = X.quality({"title": F.col("lang"), "company": F.col("source"), "description": F.col("text")})
    return _docs(spark, sf).select("doc_id", q.alias("q")).select("doc_id", F.round("q.completeness", 6).alias("completeness"), F.round("q.length_score", 6).alias("length_score"), F.round("q.keyword_score", 6).alias("keyword_score"))


def quality_full(spark: SparkSession, sf: str) -> DataFrame:
    """The whole score and whether a record needs review."""
    q = X.quality({"title": F.col("lang"), "company": F.col("source"), "description": F.col("text")})
    return _docs(spark, sf).select("doc_id", q.alias("q")).select("doc_id", F.round("q.score", 3).alias("score"), (F.col("q.score") < 0.6).alias("needs_review"))


def decay_weight(spark: SparkSession, sf: str) -> DataFrame:
    """C7."""
    return jd(spark, sf).select("id", F.round(X.decay_weight(F.col("publish_date"), F.to_date(F.lit(AS_OF))), 6).alias("decay"))


def length_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with enough text."""
    return _docs(spark, sf).where(X.joined_length(F.col("text")) >= 50).select("doc_id")


def desensitised(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text changes."""
    return _docs(spark, sf).select("doc_id", "text", X.desensitised(F.col("text")).alias("masked")).where("text <> masked").select("doc_id", "masked")


def pii_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered placeholders, and the text restored from them."""
    text, originals = X.masked(F.col("text"))
    rows = _docs(spark, sf).select("doc_id", "text", text.alias("masked"), originals.alias("originals")).where(F.size("originals") > 0)
    return rows.select("doc_id", "masked", F.array_join(F.map_keys("originals"), ",").alias("labels"), (X.restored(F.col("masked"), F.col("originals")) == F.col("text")).alias("restores"))


def rule_skills(spark: SparkSession, sf: str) -> DataFrame:
    """vocabulary words in each document."""
    return _docs(spark, sf).select("doc_id", F.array_join(X.rule_skills(F.col("text"), SKILL_WORDS, SKILL_OTHERS), ",").alias("skills"))


def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """F27."""
    return _docs(spark, sf).select("doc_id", X.token_estimate(F.col("text")).cast("long").alias("tokens"))


def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    """hash ids and running ids of skills."""
    s = table(spark, sf, "part").select(F.col("p_brand").alias("skill")).distinct()
    return running.numbered(s, "skill", "n").select("skill", X.stable_id("sk", F.col("skill")).alias("stable_id"), F.format_string("skill_%04d", "n").alias("running_id"))


def source_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """A1."""
    return quality.source_distribution(_docs(spark, sf))


def dedup_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A2: by the hash of the text."""
    s = quality.dedup_stats(_docs(spark, sf).select(F.md5("text").alias("fingerprint")))
    return s.select("total", "unique", "duplicates", _r("rate", 4))


def cr10(spark: SparkSession, sf: str) -> DataFrame:
    """A3."""
    by = jd_skill(spark, sf).groupBy("skill").agg(F.count("*").alias("cnt"))
    return quality.cr10(by).select("top", "total", _r("cr10"))


def position_diversity(spark: SparkSession, sf: str) -> DataFrame:
    """A4."""
    d = quality.position_diversity(jd_skill(spark, sf), jd(spark, sf))
    return d.select("jds", "positions", _r("avg_skills"), "mentions", "unique_skills", _r("cr10"))


def course_diversity(spark: SparkSession, sf: str) -> DataFrame:
    """A5: part types are platforms."""
    return quality.course_diversity(table(spark, sf, "part").select(F.col("p_type").alias("platform"), F.split("p_name", " ").alias("skills")))


def diversity_report(spark: SparkSession, sf: str) -> DataFrame:
    """Totals and distinct values of four tables in one list of metrics."""
    out = None
    for name, key, source in (("documents", "doc_id", "source"), ("events", "event_id", "event_type"), ("orders", "o_orderkey", "o_orderpriority"), ("part", "p_partkey", "p_brand")):
        t = table(spark, sf, name)
        m = t.agg(F.count(key).alias("rows"), F.countDistinct(source).alias("sources")).select(F.lit(name).alias("table"), "rows", "sources")
        out = m if out is None else out.unionByName(m)
    return out


def freshness(spark: SparkSession, sf: str) -> DataFrame:
    """Event types are platforms."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("ts").alias("crawled_at"))
    return quality.freshness(rows, F.to_timestamp(F.lit("2024-01-31"))).select("source", _r("days"), "fresh")


def _agg(spark: SparkSession, sf: str) -> DataFrame:
    return quality.position_aggregate(jd_skill(spark, sf))


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return quality.ad_stats(jd(spark, sf).withColumn("years", F.col("id") % 10))


def position_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """A8."""
    return _agg(spark, sf).select("position_name", "skill", "hits", "must", "sources", "level")


def ad_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Ads and exact median years."""
    return _stats(spark, sf).select("position_name", "jd_count", F.col("median_years").cast("double").alias("median_years"))


def requires_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A9."""
    return quality.requires_edges(_agg(spark, sf), _stats(spark, sf)).select("position_name", "skill", "necessity", F.col("weight").cast("double").alias("weight"))


def requires_edges_by_hits(spark: SparkSession, sf: str) -> DataFrame:
    """A10."""
    return quality.requires_edges(_agg(spark, sf), _stats(spark, sf), by_hits=True).select("position_name", "skill", "necessity")


def cross_validation(spark: SparkSession, sf: str) -> DataFrame:
    """A11."""
    v = quality.cross_validation(jd_skill(spark, sf), jd(spark, sf).withColumn("experience", F.col("id") % 10), F.to_date(F.lit(AS_OF)))
    return v.select("position_name", "source_count", F.col("verified").cast("long").alias("verified"), _r("verified_ratio"), F.array_join("unverified", ",").alias("unverified"), _r("salary_median", 4), "salary_outlier", _r("divergence"), _r("confidence"))


def validation_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A12."""
    return quality.validation_summary(quality.cross_validation(jd_skill(spark, sf), jd(spark, sf).withColumn("experience", F.col("id") % 10), F.to_date(F.lit(AS_OF))))


def outside_skills(spark: SparkSession, sf: str) -> DataFrame:
    """Brands outside a vocabulary of those that end in an odd digit."""
    inside = table(spark, sf, "part").where(F.col("p_brand").rlike("[135]$")).select(F.col("p_brand").alias("skill"))
    return quality.outside_vocabulary(jd_skill(spark, sf), inside)


def crawl_status(spark: SparkSession, sf: str) -> DataFrame:
    """Also platforms without rows."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("ts").alias("crawled_at"))
    platforms = rows.select("source").distinct().unionByName(spark.createDataFrame([("nothing",)], "source string"))
    s = quality.crawl_status(rows, platforms, F.to_date(F.lit("2024-01-30")))
    return s.select("source", "total", "today", F.date_format("last", "yyyy-MM-dd").alias("last"))


def state_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Order states stand for candidate states."""
    state = F.when(F.col("o_orderstatus") == "O", "candidate").when(F.col("o_orderstatus") == "F", "stable").otherwise("declining")
    return quality.state_histogram(table(spark, sf, "orders").select(state.alias("state")), V.STATES)


def raw_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of each user and type."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", "value")
    return ingest.latest(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


def unprocessed(spark: SparkSession, sf: str) -> DataFrame:
    """The first fifty documents without a label."""
    return ingest.unprocessed(_docs(spark, sf).select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id", 50)


def routed(spark: SparkSession, sf: str) -> DataFrame:
    """S3: rows by the table that their type goes to."""
    parts = ingest.route(table(spark, sf, "events"), "event_type", {"click": "clicks", "purchase": "sales"})
    out = None
    for name, rows in sorted(parts.items()):
        n = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """C14: chunks of at most 10 documents and 20 000 characters of each source."""
    return ingest.chunks(_docs(spark, sf), "source", "doc_id", "text", 10, 20_000)


def inflation(spark: SparkSession, sf: str) -> DataFrame:
    """M1, M2: levels by priority; skills are lines, experts full ones."""
    level = F.try_element_at(F.array(*[F.lit(x) for x in V.LEVELS]), F.substring("source", 1, 1).cast("int"))
    s = jd_skill(spark, sf).groupBy("id", "source").agg(F.count("*").alias("skills"), F.count_if(F.col("weight") > 30).alias("experts"))
    m = S.inflation(level, (F.col("id") % 16).cast("int"), F.col("skills"), F.col("experts"), (F.col("id") % 5).cast("int"))
    return s.select("id", m.alias("m")).select("id", F.round("m.score", 6).alias("score"), "m.label", F.col("m.decay").cast("double").alias("decay"))


def _courses(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    words = F.split("p_name", " ")
    covered = F.size(F.filter(words, lambda w: F.length(w) > 5)) / F.size(words)
    return p.select("p_partkey", "p_type", S.course_quality(F.when(F.col("p_size") % 2 == 0, "edx").otherwise(F.col("p_type")), F.col("p_size") / 10.0, F.col("p_retailprice") * 10, F.date_sub(F.to_date(F.lit(AS_OF)), (F.col("p_size") * 40).cast("int")), covered, (F.col("p_size") % 7).cast("int"), F.to_date(F.lit(AS_OF))).alias("q"))


def course_quality(spark: SparkSession, sf: str) -> DataFrame:
    """M3."""
    return _courses(spark, sf).select("p_partkey", F.round("q.score", 6).alias("score"), F.round("q.recency", 6).alias("recency"), F.round("q.enrollment", 6).alias("enrollment"))


def course_report(spark: SparkSession, sf: str) -> DataFrame:
    """M4: courses and recommended ones by type."""
    return _courses(spark, sf).groupBy("p_type").agg(F.count("*").alias("courses"), F.count_if("q.recommended").alias("recommended"))


def positions_normalized(spark: SparkSession, sf: str) -> DataFrame:
    """standard names of customers' positions, with English job titles made from segments."""
    from skillweft.functions.positions import normalize_positions

    titles = F.when(F.col("c_mktsegment") == "BUILDING", "Senior Software Engineer, Platform").when(F.col("c_mktsegment") == "MACHINERY", "高级React前端开发工程师").otherwise(F.col("c_mktsegment"))
    return normalize_positions(table(spark, sf, "customer").select("c_custkey", titles.alias("title")), "title", "standard")


QUERIES = {
    f.__name__: f
    for f in (simhash, near_duplicates, duplicate_mark, duplicate_purge, jaccard_pairs, fingerprint, quality_score, quality_full, decay_weight, length_filter, desensitised, pii_mask, rule_skills, token_estimate, stable_ids, source_distribution, dedup_stats, cr10, position_diversity, course_diversity, diversity_report, freshness, position_aggregate, ad_stats, requires_edges, requires_edges_by_hits, cross_validation, validation_summary, outside_skills, crawl_status, state_histogram, raw_upsert, unprocessed, routed, text_chunks, inflation, course_quality, course_report, positions_normalized)
}

_KEYWORD = " + ".join(f"CASE WHEN contains(t, '{w}') THEN 1 ELSE 0 END" for w in V.CORE_KEYWORDS)
#: A letter twenty times in a row, letter by letter, and control characters.
_RUNS = "|".join(c + "{20,}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZäöüßéèêëçàâîïôûùñóíáúÄÖÜÉÈÊÇÀÑÓÍÁÚ") + r"|[\x00-\x08\x0b\x0c\x0e-\x1f]"


def _masked(text: str) -> str:
    """C5 in SQL: a number's neighbours are no digits; twice, as neighbours are shared."""
    for inner, label in (("[0-9]{17}[0-9Xx]", "ID_CARD"), ("1[3-9][0-9]{9}", "PHONE")):
        for _ in range(2):
            text = f"regexp_replace({text}, '(^|[^0-9]){inner}($|[^0-9])', '\\1[{label}]\\2', 'g')"
    return f"regexp_replace({text}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}', '[EMAIL]', 'g')"


_PRINT = """WITH tok AS (SELECT doc_id, md5(unnest(regexp_extract_all(lower(text), '[a-z0-9]+|[一-鿿]{2,}'))) AS h FROM documents),
bits AS (SELECT doc_id, i, sum(CASE WHEN (CAST(('0x' || substr(h, 1, 16)) AS UBIGINT) >> i) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM tok, range(64) AS t(i) GROUP BY ALL),
p AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN CAST(1 AS HUGEINT) << CAST(i AS INT) ELSE 0 END) AS u FROM bits GROUP BY ALL),
prints AS (SELECT documents.doc_id, CAST(CASE WHEN u >= (CAST(1 AS HUGEINT) << 63) THEN u - (CAST(1 AS HUGEINT) << 64) ELSE coalesce(u, 0) END AS BIGINT) AS simhash FROM documents LEFT JOIN p USING (doc_id))"""
_NEAR = _PRINT + ", d AS (SELECT DISTINCT simhash FROM prints), near AS (SELECT x.simhash AS a, y.simhash AS b, CAST(bit_count(xor(x.simhash, y.simhash)) AS BIGINT) AS distance FROM d x JOIN d y ON x.simhash < y.simhash AND bit_count(xor(x.simhash, y.simhash)) <= 3)"
_MARK = _NEAR + ", mark AS (SELECT x.doc_id, min(y.doc_id) AS low FROM prints x JOIN prints y ON bit_count(xor(x.simhash, y.simhash)) <= 3 GROUP BY ALL)"
_A8 = with_views("jd", "jd_skill") + """lv AS (SELECT position_name, skill, level, count(*) AS n, min((id, seq)) AS first FROM jd_skill GROUP BY ALL),
mode AS (SELECT position_name, skill, level FROM (SELECT *, row_number() OVER (PARTITION BY position_name, skill ORDER BY n DESC, first, level) AS rn FROM lv) WHERE rn = 1),
ad AS (SELECT position_name, skill, id, source, bool_or(necessity = 'must') AS must FROM jd_skill GROUP BY ALL),
agg AS (SELECT position_name, skill, count(*) AS hits, count_if(must) AS must, count(DISTINCT source) AS sources FROM ad GROUP BY ALL),
st AS (SELECT position_name, count(*) AS jd_count, median(id % 10) AS median_years FROM jd GROUP BY ALL)"""
_A11 = with_views("jd", "jd_skill") + f"""seen AS (SELECT position_name, skill, count(DISTINCT source) AS n FROM jd_skill GROUP BY ALL),
ver AS (SELECT position_name, count_if(n >= 2) AS verified, count(*) AS skills, coalesce(string_agg(skill, ',' ORDER BY skill) FILTER (n < 2), '') AS unverified FROM seen GROUP BY ALL),
grp AS (SELECT position_name, count(DISTINCT source) AS source_count, median(salary) AS salary_median, max(salary) / min(salary) > 1.5 AS salary_outlier, count(DISTINCT id % 10) / count(*) AS divergence, date_diff('day', max(publish_date), DATE '{AS_OF}') AS days FROM jd GROUP BY ALL),
xv AS (SELECT *, verified / skills AS verified_ratio, least(source_count / 3, 1.0) * 0.4 + verified / skills * 0.4 + CASE WHEN days <= 7 THEN 1.0 WHEN days <= 30 THEN 0.8 ELSE 0.6 END * 0.2 AS confidence FROM grp LEFT JOIN ver USING (position_name))"""
_M3 = f"""WITH c AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.5 END AS authority, least(p_size / 50, 1.0) AS rated, least(log10(p_retailprice * 10) / 5, 1.0) AS enrollment, CASE WHEN p_size * 40 <= 730 THEN 1.0 WHEN p_size * 40 >= 1825 THEN 0.5 ELSE 1.0 - (p_size * 40 - 730) * (0.5 / 1095) END AS recency, len(list_filter(string_split(p_name, ' '), lambda w: length(w) > 5)) / len(string_split(p_name, ' ')) AS coverage, least((p_size % 7) / 5, 1.0) AS projects FROM part),
q AS (SELECT *, authority * 0.25 + rated * 0.2 + enrollment * 0.15 + recency * 0.2 + coverage * 0.1 + projects * 0.1 AS score FROM c)"""
_CEIL = lambda t: "CASE lv " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.items()) + " END"
_LV = "CASE substr(source, 1, 1) " + " ".join(f"WHEN '{i + 1}' THEN '{x}'" for i, x in enumerate(V.LEVELS)) + " END"
_OVER = lambda x, t, f: f"least(greatest({x} - {_CEIL(t)}, 0) / {f}, 1.0)"

ORACLES = {
    "simhash": _PRINT + " SELECT * FROM prints",
    "near_duplicates": _NEAR + " SELECT * FROM near",
    "duplicate_mark": _MARK + " SELECT doc_id, CASE WHEN low < doc_id THEN low ELSE -1 END AS duplicate_of FROM mark",
    "duplicate_purge": _MARK + " SELECT doc_id AS id FROM mark JOIN documents USING (doc_id) WHERE NOT (low < doc_id AND source = 'src0')",
    "jaccard_pairs": with_views("jd", "jd_skill") + "s AS (SELECT id, coalesce(list(DISTINCT skill) FILTER (necessity = 'must'), []) AS a, coalesce(list(DISTINCT skill) FILTER (necessity = 'nice'), []) AS b FROM jd_skill GROUP BY ALL) SELECT id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM s",
    "fingerprint": "SELECT doc_id, sha256(source || ':' || doc_id) AS fingerprint FROM documents",
    "quality_score": f"WITH d AS (SELECT *, lang || ' ' || text AS t FROM documents) SELECT doc_id, round((CASE WHEN trim(lang) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(source) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END) / 6, 6) AS completeness, round(least(length(t) / 200, 1.0), 6) AS length_score, round(least(({_KEYWORD}) / 3, 1.0), 6) AS keyword_score FROM d",
    "quality_full": f"WITH d AS (SELECT *, concat_ws(' ', nullif(lang, ''), nullif(text, '')) AS t FROM documents), q AS (SELECT doc_id, (CASE WHEN trim(lang) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(source) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END) / 6 * 0.4::DOUBLE + least(length(t) / 200, 1.0) * 0.3::DOUBLE + least(({_KEYWORD}) / 3, 1.0) * 0.2::DOUBLE + CASE WHEN regexp_matches(t, '{_RUNS}') THEN 0.5 ELSE 1.0 END * 0.1::DOUBLE AS score FROM d) SELECT doc_id, round(score, 3) AS score, score < 0.6 AS needs_review FROM q",
    "desensitised": "WITH m AS (SELECT doc_id, text, " + _masked("text") + " AS masked FROM documents) SELECT doc_id, masked FROM m WHERE masked <> text",
    "decay_weight": with_views("jd")[:-2] + f" SELECT id, round(CASE WHEN date_diff('day', publish_date, DATE '{AS_OF}') <= 30 THEN 1.0 ELSE exp(-0.01 * (date_diff('day', publish_date, DATE '{AS_OF}') - 30)) END, 6) AS decay FROM jd",
    "length_filter": "SELECT doc_id FROM documents WHERE length(text) >= 50",
    "rule_skills": "SELECT doc_id, array_to_string(list_sort(list_filter([" + ", ".join(f"'{w}'" for w in SKILL_WORDS) + "], lambda w: contains(lower(text), lower(w)) OR (w = 'ation' AND contains(lower(text), 'tion'))) || CASE WHEN contains(lower(text), 'ing ') THEN ['gerund'] ELSE [] END), ',') AS skills FROM documents",
    "token_estimate": "SELECT doc_id, CAST(len(regexp_extract_all(text, '[一-鿿]')) + ceil((length(text) - len(regexp_extract_all(text, '[一-鿿]'))) / 4) AS BIGINT) AS tokens FROM documents",
    "stable_ids": "SELECT skill, 'sk_' || substr(sha1(skill), 1, 8) AS stable_id, printf('skill_%04d', dense_rank() OVER (ORDER BY skill)) AS running_id FROM (SELECT DISTINCT p_brand AS skill FROM part)",
    "source_distribution": "SELECT coalesce(nullif(trim(source), ''), 'unknown') AS source, count(*) AS cnt FROM documents GROUP BY ALL",
    "dedup_stats": "SELECT count(*) AS total, count(DISTINCT md5(text)) AS \"unique\", count(*) - count(DISTINCT md5(text)) AS duplicates, round((count(*) - count(DISTINCT md5(text))) / count(*), 4) AS rate FROM documents",
    "cr10": with_views("jd", "jd_skill") + "b AS (SELECT skill, count(*) AS cnt FROM jd_skill GROUP BY ALL), t AS (SELECT * FROM b ORDER BY cnt DESC, skill LIMIT 10) SELECT CAST((SELECT sum(cnt) FROM t) AS BIGINT) AS top, CAST(sum(cnt) AS BIGINT) AS total, round((SELECT sum(cnt) FROM t) / sum(cnt), 6) AS cr10 FROM b",
    "position_diversity": with_views("jd", "jd_skill") + "b AS (SELECT skill, count(*) AS cnt FROM jd_skill GROUP BY ALL), t AS (SELECT * FROM b ORDER BY cnt DESC, skill LIMIT 10), j AS (SELECT count(*) AS jds, count(DISTINCT position_name) AS positions FROM jd) SELECT jds, positions, round(m / jds, 6) AS avg_skills, CAST(m AS BIGINT) AS mentions, u AS unique_skills, round((SELECT sum(cnt) FROM t) / m, 6) AS cr10 FROM j, (SELECT sum(cnt) AS m, count(*) AS u FROM b)",
    "course_diversity": "SELECT p_type AS platform, count(DISTINCT p_partkey) AS courses, count(DISTINCT s) AS skills FROM (SELECT p_type, p_partkey, unnest(string_split(p_name, ' ')) AS s FROM part) GROUP BY ALL",
    "diversity_report": "SELECT 'documents' AS \"table\", count(doc_id) AS rows, count(DISTINCT source) AS sources FROM documents UNION ALL SELECT 'events', count(*), count(DISTINCT event_type) FROM events UNION ALL SELECT 'orders', count(*), count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'part', count(*), count(DISTINCT p_brand) FROM part",
    "freshness": "WITH f AS (SELECT event_type AS source, (epoch(TIMESTAMP '2024-01-31') - floor(epoch(max(ts)))) / 86400 AS days FROM events GROUP BY ALL) SELECT source, round(days, 6) AS days, days <= 1 AS fresh FROM f",
    "position_aggregate": _A8 + " SELECT position_name, skill, hits, CAST(must AS BIGINT) AS must, sources, level FROM agg JOIN mode USING (position_name, skill)",
    "ad_stats": _A8 + " SELECT * FROM st",
    "requires_edges": _A8 + " SELECT position_name, skill, CASE WHEN m THEN 'must' ELSE 'nice' END AS necessity, CAST(CASE WHEN m THEN 0.8 ELSE 0.4 END AS DOUBLE) AS weight FROM (SELECT *, CASE WHEN jd_count >= 3 THEN must / jd_count > 0.5 ELSE must / hits >= 0.5 END AS m FROM agg JOIN st USING (position_name))",
    "requires_edges_by_hits": _A8 + " SELECT position_name, skill, CASE WHEN must / hits >= 0.5 THEN 'must' ELSE 'nice' END AS necessity FROM agg",
    "cross_validation": _A11 + " SELECT position_name, source_count, CAST(verified AS BIGINT) AS verified, round(verified_ratio, 6) AS verified_ratio, unverified, round(salary_median, 4) AS salary_median, salary_outlier, round(divergence, 6) AS divergence, round(confidence, 6) AS confidence FROM xv WHERE skills IS NOT NULL UNION ALL SELECT position_name, source_count, NULL, 0.0, NULL, round(salary_median, 4), salary_outlier, round(divergence, 6), round(confidence, 6) FROM xv WHERE skills IS NULL",
    "validation_summary": _A11 + " SELECT count(*) AS positions, CAST(count_if(salary_outlier) AS BIGINT) AS outliers, CAST(count_if(confidence >= 0.6) AS BIGINT) AS trusted FROM xv",
    "outside_skills": with_views("jd", "jd_skill")[:-2] + " SELECT lower(skill) AS skill, count(DISTINCT id) AS cnt FROM jd_skill WHERE lower(skill) NOT IN (SELECT lower(p_brand) FROM part WHERE regexp_matches(p_brand, '[135]$')) GROUP BY ALL",
    "crawl_status": "SELECT event_type AS source, count(*) AS total, CAST(count_if(CAST(ts AS DATE) = DATE '2024-01-30') AS BIGINT) AS today, strftime(max(ts), '%Y-%m-%d') AS last FROM events GROUP BY ALL UNION ALL SELECT 'nothing', 0, 0, NULL",
    "state_histogram": "SELECT s.state, count(o_orderkey) AS n FROM (SELECT unnest([" + ", ".join(f"'{s}'" for s in V.STATES) + "]) AS state) s LEFT JOIN orders ON state = CASE o_orderstatus WHEN 'O' THEN 'candidate' WHEN 'F' THEN 'stable' ELSE 'declining' END GROUP BY ALL",
    "raw_upsert": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "unprocessed": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 50",
    "routed": "SELECT 'clicks' AS \"table\", CAST(count_if(event_type = 'click') AS BIGINT) AS n FROM events UNION ALL SELECT 'sales', CAST(count_if(event_type = 'purchase') AS BIGINT) FROM events",
    "text_chunks": """WITH RECURSIVE d AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
r(source, doc_id, i, chunk, held, chars) AS (SELECT source, doc_id, i, CAST(0 AS BIGINT), CAST(1 AS BIGINT), n FROM d WHERE i = 1 UNION ALL SELECT d.source, d.doc_id, d.i, CASE WHEN r.held >= 10 OR r.chars + d.n > 20000 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.held >= 10 OR r.chars + d.n > 20000 THEN 1 ELSE r.held + 1 END, CASE WHEN r.held >= 10 OR r.chars + d.n > 20000 THEN d.n ELSE r.chars + d.n END FROM r JOIN d ON d.source = r.source AND d.i = r.i + 1)
SELECT source, doc_id, chunk FROM r""",
    "inflation": with_views("jd", "jd_skill") + f"s AS (SELECT id, {_LV} AS lv, count(*) AS skills, count_if(weight > 30) AS experts FROM jd_skill GROUP BY ALL), m AS (SELECT id, least({_OVER('id % 16', V.EXPERIENCE_CEILING, 5)} * 0.689 + {_OVER('skills', V.SKILL_CEILING, 6)} * 0.695 + {_OVER('experts', V.EXPERT_CEILING, 3)} * 0.448 + {_OVER('id % 5', V.EDUCATION_CEILING, 2)} * 0.622, 1.0) AS score FROM s) SELECT id, round(score, 6) AS score, CASE WHEN score > 0.7 THEN 'severe_inflation' WHEN score >= 0.4 THEN 'mild_inflation' ELSE 'normal' END AS label, CAST(CASE WHEN score > 0.7 THEN 0.4 WHEN score >= 0.4 THEN 0.7 ELSE 1.0 END AS DOUBLE) AS decay FROM m",
    "course_quality": _M3 + " SELECT p_partkey, round(score, 6) AS score, round(recency, 6) AS recency, round(enrollment, 6) AS enrollment FROM q",
    "course_report": _M3 + " SELECT p_type, count(*) AS courses, CAST(count_if(score >= 0.65) AS BIGINT) AS recommended FROM q GROUP BY ALL",
}
