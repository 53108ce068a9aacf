"""Named queries over the graph, its versions, matching, retrieval and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweft.functions import scores as S
from skillweft.operators import clusters, communities, evaluation, graph, inverted, matching, quality, retrieval, similarity
from skillweft.operators.nearest import nearest
from skillweft.plans.views import CHINESE, chinese, dealt, jd, jd_skill, requires, snapshots, table
from skillweft.sources.staging import shared_path, small, staged

AS_OF = "2001-08-01"


def _r(name: str, n: int = 6):
    return F.round(name, n).alias(name)


def _freqs(spark: SparkSession, sf: str) -> DataFrame:
    return jd(spark, sf).groupBy("position_name").agg(F.count("*").alias("freq"))


def panorama(spark: SparkSession, sf: str) -> DataFrame:
    """T1, N2."""
    return graph.panorama(requires(spark, sf), _freqs(spark, sf), 10).select("position_name", "skill", "weight", "freq")


def techstack(spark: SparkSession, sf: str) -> DataFrame:
    """T2."""
    return graph.tech_stack(requires(spark, sf), 5).select("position_name", "skill", "degree")


def graph_view(spark: SparkSession, sf: str) -> DataFrame:
    """V4."""
    return graph.graph_view(requires(spark, sf), _freqs(spark, sf), "both", 3)


def expand_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Strong edges of positions of one segment."""
    chosen = _freqs(spark, sf).where(F.col("position_name").startswith("BUILDING"))
    return graph.expand(requires(spark, sf), chosen, 2)


def reverse_skill(spark: SparkSession, sf: str) -> DataFrame:
    """N3."""
    return graph.reverse(requires(spark, sf), "Brand#11")


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    return jd_skill(spark, sf).select("skill", "source", F.col("id").alias("ref"))


def evidence_refs(spark: SparkSession, sf: str) -> DataFrame:
    """N4."""
    return graph.evidence_refs(requires(spark, sf), _evidence(spark, sf)).select("position_name", "skill", "source", "ref", _r("confidence"))


def skill_detail(spark: SparkSession, sf: str) -> DataFrame:
    """N5, N24."""
    return graph.skill_detail(requires(spark, sf), _evidence(spark, sf))


def cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    """N6."""
    return graph.cooccurrence(requires(spark, sf))


def degrees(spark: SparkSession, sf: str) -> DataFrame:
    """G8."""
    return graph.degrees(requires(spark, sf).select(F.col("position_name").alias("src"), F.col("skill").alias("dst")))


def filtered_skills(spark: SparkSession, sf: str) -> DataFrame:
    """C12."""
    stop, white = spark.createDataFrame([("Brand#12",)], "skill string"), spark.createDataFrame([("Brand#13",)], "skill string")
    return graph.filtered_skills(requires(spark, sf), stop, white, 3)


def merge_vertices(spark: SparkSession, sf: str) -> DataFrame:
    """Positions with one segment are one."""
    e = requires(spark, sf)
    return graph.merge_vertices(e, e.select("position_name").distinct().withColumn("standard", F.split_part("position_name", F.lit("/"), F.lit(1))))


def relation_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Relations between brands, in both directions, whose ends are brands of parts."""
    p = table(spark, sf, "part")
    new = p.select(F.col("p_brand").alias("src"), F.concat(F.lit("Brand#"), (F.col("p_partkey") % 60).cast("string")).alias("dst"))
    return graph.relations(new, p.select(F.col("p_brand").alias("id")).distinct(), both_ways=True)


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    e = snapshots(spark, sf)
    return e.groupBy("version", F.col("target").alias("id")).agg(F.when(F.count("*") > 3, "core").otherwise("rare").alias("type")).withColumn("name", F.col("id"))


def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """V1: nodes of two months."""
    n = _nodes(spark, sf)
    return graph.snapshot_diff(n.where("version = '2000-01'"), n.where("version = '2000-06'"))


def edge_diff(spark: SparkSession, sf: str) -> DataFrame:
    """V1: edges of two months."""
    e = snapshots(spark, sf)
    return graph.edge_diff(*(e.where(F.col("version") == v).select("source", "target") for v in ("2000-01", "2000-06")))


def version_counters(spark: SparkSession, sf: str) -> DataFrame:
    """V2."""
    return graph.version_counters(_nodes(spark, sf))


def type_counts(spark: SparkSession, sf: str) -> DataFrame:
    """J6."""
    return graph.type_counts(_nodes(spark, sf))


def retained_versions(spark: SparkSession, sf: str) -> DataFrame:
    """V3: nodes of kept versions."""
    return graph.retained(_nodes(spark, sf), "2001-01").groupBy("version").agg(F.count("*").alias("n"))


def edit_diff(spark: SparkSession, sf: str) -> DataFrame:
    """V5, V6: skills of positions before and after 2000."""
    s = jd_skill(spark, sf)
    side = lambda c: s.where(c).groupBy("position_name", "skill").agg(F.max("necessity").alias("necessity"))
    return graph.edit_diff(side("publish_date < '2000-01-01'"), side("publish_date >= '2000-01-01'"), ["position_name"])


def evolved_from(spark: SparkSession, sf: str) -> DataFrame:
    """Names made of types against the parts' names."""
    p = table(spark, sf, "part")
    old, new = p.select(F.col("p_name").alias("name")).distinct(), p.select(F.concat_ws(" ", F.lower("p_type"), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("name")).distinct()
    return graph.evolved_from(new.subtract(old), old.subtract(new), 4).select("new", "old", F.col("shared").cast("long").alias("shared"), "relation")


def pagerank(spark: SparkSession, sf: str) -> DataFrame:
    """G1: of nations and brands by segment that share as many ads as the mean of all pairs at least, until no rank moves by the tolerance."""
    e = requires(spark, sf).select(F.split_part("position_name", F.lit("/"), F.lit(2)).alias("a"), F.concat("skill", F.lit("/"), F.substring("position_name", 1, 1)).alias("b"), "weight").groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    e = staged(e, shared_path(spark, "shared"))
    e = e.join(F.broadcast(e.agg(F.avg("weight").alias("mean"))), how="cross").where(F.col("weight") >= F.col("mean")).select("a", "b")  # one row
    return graph.pagerank(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))).select("id", F.round("rank", 4).alias("rank"))


def _communities(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pairs = graph.cooccurrence(requires(spark, sf))
    ids = pairs.select("a").union(pairs.select("b")).distinct().toDF("id")
    return pairs, ids.withColumn("community", F.substring("id", 7, 1).cast("long"))


def modularity(spark: SparkSession, sf: str) -> DataFrame:
    """Of brands by their first digit."""
    return graph.modularity(*_communities(spark, sf)).select(_r("q"))


def louvain(spark: SparkSession, sf: str) -> DataFrame:
    """Brands by the positions that they share; those with one remainder by five are ten times as close, others a tenth."""
    pairs = graph.cooccurrence(requires(spark, sf))
    near = F.substring("a", 7, 9).cast("int") % 5 == F.substring("b", 7, 9).cast("int") % 5
    c = graph.clusters(communities.louvain(pairs.withColumn("weight", F.col("weight") * F.when(near, 10.0).otherwise(0.1))))
    return c.select("community", "size", F.array_join("members", ",").alias("members"))


def _chain_graph(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    e = p.select(F.concat(F.lit("p"), (F.col("p_partkey") % 40).cast("string")).alias("a"), F.concat(F.lit("p"), (F.col("p_size") % 40).cast("string")).alias("b")).where("a <> b and p_partkey % 40 < p_size % 40 + 6")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    """G4."""
    return graph.shortest_path(_chain_graph(spark, sf), "p0", "p39").select(F.array_join("path", ">").alias("path"))


def _prerequisites(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return n.where("n_nationkey > 0").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.floor(F.col("n_nationkey") / 2).cast("string")).alias("dst"))


def prereq_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Which skills come before which."""
    return graph.reachable(_prerequisites(spark, sf))


def prereq_order(spark: SparkSession, sf: str) -> DataFrame:
    """In the order to learn them."""
    e = _prerequisites(spark, sf)
    return graph.chain_order(e, e.select(F.col("src").alias("skill")).distinct()).select("skill", F.array_join("chain", ",").alias("chain"))


def _candidates_of(skills: DataFrame) -> DataFrame:
    return skills.groupBy(F.col("company").alias("candidate"), "skill").agg(F.least(F.count("*"), F.lit(3)).cast("int").alias("proficiency"), (F.max("weight") < 10).alias("low_confidence"))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates_of(jd_skill(spark, sf))


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    return _positions_of(jd_skill(spark, sf), jd(spark, sf))


def _positions_of(skills: DataFrame, ads: DataFrame) -> DataFrame:
    agg = quality.position_aggregate(skills)
    stats = quality.ad_stats(ads.withColumn("years", F.col("id") % 10))
    level = F.when(F.col("hits") % 4 == 0, "初级").when(F.col("hits") % 4 == 1, "中级").when(F.col("hits") % 4 == 2, "高级").otherwise("专家")
    return quality.requires_edges(agg, stats).select("position_name", "skill", "necessity", (F.col("weight") + F.col("hits") / 1000.0).alias("weight"), level.alias("proficiency"), F.col("hits").alias("source_count"))


def cii(spark: SparkSession, sf: str) -> DataFrame:
    """M12."""
    return matching.cii_corrected(_positions(spark, sf)).select("position_name", "skill", "necessity", "demoted")


def _matching(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, positions and ads; the first two are aggregates, written once for all that is made of them."""
    work = shared_path(spark, "matching")
    skills = staged(jd_skill(spark, sf).select("id", "seq", "company", "position_name", "source", "skill", "necessity", "level", "weight"), f"{work}/skills")
    ads = staged(jd(spark, sf).select("id", "company", "position_name", "publish_date"), f"{work}/ads")
    n = skills.count()
    return staged(_candidates_of(dealt(skills, n, "company", "skill")), f"{work}/candidates"), staged(_positions_of(dealt(skills, n, "id"), ads), f"{work}/positions"), ads


def rough_select(spark: SparkSession, sf: str) -> DataFrame:
    """Five positions a candidate."""
    c, p, _ = _matching(spark, sf)
    return matching.rough_select(c, p, 5)


def _scorable(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What ``matching.scores`` takes: candidates and their years, positions and their measures."""
    c, p, ads = _matching(spark, sf)
    years = ads.groupBy(F.col("company").alias("candidate")).agg((F.datediff(F.max("publish_date"), F.min("publish_date")) / 365.0).alias("total_years"))
    meta = ads.groupBy("position_name").agg(F.median(F.col("id") % 10).cast("double").alias("required_years"), S.staleness_penalty(F.max("publish_date"), F.to_date(F.lit(AS_OF))).cast("double").alias("staleness"))
    return c, years, matching.cii_corrected(p), meta


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all candidates and positions that have a skill in common."""
    return matching.scores(*_scorable(spark, sf))


def match_scores(spark: SparkSession, sf: str) -> DataFrame:
    """M13, W22."""
    return _scored(spark, sf).select("candidate", "position_name", _r("must_score"), _r("nice_score"), _r("exp_score"), _r("total_score"), "unqualified")


def match_topn(spark: SparkSession, sf: str) -> DataFrame:
    """The two best of all positions and what is missing."""
    t = matching.top_matches(_scored(spark, sf), 2)
    return t.select("candidate", F.col("rank").cast("long").alias("rank"), "position_name", F.array_join("missing_must", ",").alias("missing"))


def _gaps(spark: SparkSession, sf: str) -> DataFrame:
    c, p, _ = _matching(spark, sf)
    return matching.gaps(c, p, matching.rough_select(c, p, 1))


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    """M15."""
    return _gaps(spark, sf).select("candidate", "position_name", "skill", "gap", "priority")


def learning_hours(spark: SparkSession, sf: str) -> DataFrame:
    """M16."""
    hours = spark.createDataFrame([("Brand#11", 80.0), ("Brand#22", 12.5)], "skill string, hours double")
    path = matching.learning_path(_gaps(spark, sf), hours)
    return path.groupBy("candidate", "position_name").agg(F.round(F.sum("hours"), 1).alias("hours"), F.count("*").alias("skills"))


def course_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """T4: the three dearest parts of each brand; cheap ones have no score."""
    c = table(spark, sf, "part").select(F.col("p_brand").alias("skill"), F.col("p_partkey").alias("course"), F.when(F.col("p_retailprice") > 1000, F.col("p_retailprice")).alias("score"))
    return matching.ranked_courses(c).select("skill", "course", F.col("rank").cast("long").alias("rank"))


def staleness(spark: SparkSession, sf: str) -> DataFrame:
    """W22."""
    return jd(spark, sf).select("id", S.staleness_penalty(F.col("publish_date"), F.to_date(F.lit(AS_OF))).cast("double").alias("penalty"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def knn(spark: SparkSession, sf: str) -> DataFrame:
    """Of every vector the five nearest others from 0.25 up."""
    v = _vectors(spark, sf)
    return nearest(v, v, 0.25, 5, other=True).select("a", "b", F.round("score", 6).alias("score"))


def nn_align(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest of all other vectors, from 0.2 up."""
    v = _vectors(spark, sf)
    return nearest(v, v, 0.2, other=True).select("a", "b", F.round("score", 6).alias("score"))


def verified_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours in id whose vectors agree; the last one's neighbour has none."""
    v = _vectors(spark, sf)
    pairs = v.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return similarity.verified_pairs(pairs, v.select("id", "vector"), 0.1)


def hit_merge(spark: SparkSession, sf: str) -> DataFrame:
    """V7: the ten best users of two event types."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("code"), F.col("value").alias("score"))
    return retrieval.merge_hits(e, "code", 10)


def rag_budget(spark: SparkSession, sf: str) -> DataFrame:
    """V8: documents by source within 2000 tokens."""
    d = table(spark, sf, "documents").select("source", "doc_id", (F.length("text") % 997).cast("double").alias("score"), F.ceil(F.length("text") / 4).alias("tokens"))
    return retrieval.within_budget(d, "source", "doc_id", "tokens", 2000, 5)


def both_names(spark: SparkSession, sf: str) -> DataFrame:
    """``name``: positions, and a Chinese one for each, without spaces."""
    names = _freqs(spark, sf).select(F.col("position_name").alias("name"))
    return names.unionByName(names.select(chinese(F.col("name")).alias("name"))).distinct()


def seed_match(spark: SparkSession, sf: str) -> DataFrame:
    """Positions in both languages."""
    seeds = spark.createDataFrame([(1, "goods", ["goods", "NATION_1"]), (2, "house", ["HOUSE"]), (3, "build", ["BUILDING/NATION_10 AND MORE"])], "seed_order int, seed string, terms array<string>")
    return retrieval.match_seeds(both_names(spark, sf), seeds.unionByName(spark.createDataFrame([(4, "数据", ["数据工程师"], ), (5, "云", ["腾讯云计算产品工程师平台"])], seeds.schema)))


def keyword_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by name or by a word of their type."""
    v = table(spark, sf, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.split("p_type", " ").alias("aliases"))
    return retrieval.keyword_hits(v, "o")


def fulltext(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by BM25."""
    return retrieval.bm25(table(spark, sf, "documents"), "doc_id", "text", "the licensed").select("doc_id", _r("score"))


def fulltext_index(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty best documents for two words from an index that was written in three batches, one of them twice."""
    docs, index = table(spark, sf, "documents"), inverted.InvertedIndex(spark, shared_path(spark, "fulltext"))
    for name in ("even", "odd", "even"):
        index.add(docs.where(F.col("doc_id") % 2 == (0 if name == "even" else 1)), "doc_id", "text", name)
    return index.search("the licensed", 20).select(F.col("key").cast("long").alias("doc_id"), _r("score"))


def fulltext_indexes(spark: SparkSession, sf: str) -> DataFrame:
    """The five best of parts, pages of customers, nations and documents for two words."""
    t = lambda name, key, text: (table(spark, sf, name), key, text)
    words = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", F.regexp_replace("p_brand", "#", " ")).alias("t"))
    found = retrieval.search({"part": (words, "p_partkey", "t"), "customer": t("customer", "c_custkey", "c_mktsegment"), "nation": t("nation", "n_nationkey", "n_name"), "document": t("documents", "doc_id", "text")}, "ring building", 5)
    return found.select("index", "key", F.round("score", 4).alias("score"))


def occupation_align(spark: SparkSession, sf: str) -> DataFrame:
    """Positions in both languages against names and aliases that stand anywhere in them."""
    v = table(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("X"), F.col("n_name")), F.element_at(F.array(*map(F.lit, CHINESE["BUILDING"])), F.col("n_nationkey") % 3 + 1)).alias("aliases"))
    return similarity.aligned(both_names(spark, sf), v)


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"), "lang")
    return table(spark, sf, "labels").join(d, "doc_id")


def f1(spark: SparkSession, sf: str) -> DataFrame:
    """Must brands of ads predicted by those of their large lines."""
    s = jd_skill(spark, sf).groupBy("id").agg(F.collect_set(F.when(F.col("necessity") == "must", F.col("skill"))).alias("gold"), F.collect_set(F.when(F.col("weight") > 20, F.col("skill"))).alias("pred"))
    return evaluation.f1(s).select("tp", "fp", "fn", _r("precision"), _r("recall"), _r("f1"))


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    """A22."""
    return evaluation.confusion(_labelled(spark, sf).select(F.col("quality").alias("gold"), F.col("toxic").alias("pred")))


def recall_fpr(spark: SparkSession, sf: str) -> DataFrame:
    """Long documents against their quality."""
    return evaluation.recall_fpr(_labelled(spark, sf).select((F.col("n") > 500).alias("pred"), (F.col("quality") == 1).alias("gold"))).select(_r("recall"), _r("fpr"))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """Length limits."""
    rows = _labelled(spark, sf).select("n", (F.col("quality") == 1).alias("gold"))
    points = spark.createDataFrame([(x,) for x in (50, 200, 500, 1000, 2000)], "limit long")
    return evaluation.grid_search(rows, points, F.col("n") > F.col("limit")).select("limit", _r("recall"), _r("fpr"), F.col("rank").cast("long").alias("rank"))


def spearman(spark: SparkSession, sf: str) -> DataFrame:
    """Size and price of parts."""
    return evaluation.spearman(table(spark, sf, "part").select("p_size", "p_retailprice"), "p_size", "p_retailprice").select(_r("rho"))


def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """A24."""
    return evaluation.accuracy_at(_labelled(spark, sf).select((F.col("n") / 2000).alias("score"), F.col("quality").alias("label"))).select(_r("accuracy"))


def top3(spark: SparkSession, sf: str) -> DataFrame:
    """Of all positions with a common skill; positives have an odd number of ads."""
    rows = _scored(spark, sf).join(small(_freqs(spark, sf)), "position_name").select("candidate", "position_name", F.round("total_score", 6).alias("score"), (F.col("freq") % 2).alias("label"))
    return evaluation.top3(rows).select("candidates", _r("accuracy"))


def kappa(spark: SparkSession, sf: str) -> DataFrame:
    """A26."""
    return evaluation.kappa(_labelled(spark, sf).select((F.col("n") / 2000).alias("a"), F.col("quality").alias("b")), "a", "b").select(_r("kappa"))


def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Three documents of each language and source, filled up to 120."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return evaluation.stratified_sample(d, ["lang", "source"], ["source", "doc_id"], 3, 120)


def labelled_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Of every ad its own skills in part, and those of two that share one skill at most."""
    ads = jd_skill(spark, sf).groupBy("id").agg(F.collect_set("skill").alias("skills"))
    return evaluation.golden_pairs(ads, "id", "skills", draws=256).withColumn("candidate_skills", F.array_join("candidate_skills", ","))


def normalize_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors are the vocabulary."""
    v = _vectors(spark, sf).select(F.col("id").cast("string").alias("name"), "vector")
    return clusters.normalize_clusters(v.select("name", F.col("name").cast("long").alias("seq"), F.lit(1).alias("cnt")), v, 0.3)


def mli(spark: SparkSession, sf: str) -> DataFrame:
    """Event types are classes of sources."""
    from skillweft.functions import text as X
    from skillweft.operators import trends

    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "click", "paper").when(F.col("event_type") == "purchase", "course").when(F.col("event_type") == "view", "community").otherwise("jd")
    s = e.groupBy(F.col("user_id").alias("skill"), kind.alias("class"), X.week_key(F.col("ts")).alias("period")).agg((F.count("*") / 4.0).alias("value"))
    return trends.mli_overview(s).select("skill", _r("mli"), "ready")


def state_transition(spark: SparkSession, sf: str) -> DataFrame:
    """M8, M9: segments by their monthly windows."""
    from skillweft.operators import discovery, trends
    from skillweft.plans.trend_queries import _segments

    w = _segments(spark, sf)
    z = trends.freq_zscores(w, "name", "version")
    s = trends.series(w, "name", "version").join(trends.series(z.select("name", "version", F.col("z").alias("freq")), "name", "version").withColumnRenamed("freqs", "z"), "name")
    state = F.when(F.col("name") == "BUILDING", "declining").when(F.col("name") == "MACHINERY", "stable").otherwise("emerging")
    return discovery.transitions(s.withColumn("state", state).withColumn("confidence", F.lit(0.9)).withColumn("sources", F.lit(3))).select("name", "state", "next_state")


QUERIES = {
    f.__name__: f
    for f in (panorama, techstack, graph_view, expand_edges, reverse_skill, evidence_refs, skill_detail, cooccurrence, degrees, filtered_skills, merge_vertices, relation_edges, snapshot_diff, edge_diff, version_counters, type_counts, retained_versions, edit_diff, evolved_from, pagerank, modularity, louvain, shortest_path, prereq_chain, prereq_order, cii, rough_select, match_scores, match_topn, gaps, learning_hours, course_ranking, staleness, knn, nn_align, verified_pairs, hit_merge, rag_budget, seed_match, keyword_hits, fulltext, fulltext_index, fulltext_indexes, occupation_align, f1, confusion, recall_fpr, grid, spearman, accuracy, top3, kappa, stratified_sample, labelled_pairs, normalize_clusters, mli, state_transition)
}

from skillweft.plans.graph_sql import ORACLES  # noqa: E402, F401
