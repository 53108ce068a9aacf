"""Operators that the queries don't reach, and their edge cases."""

import datetime as dt

from pyspark.sql import functions as F

from skillweft.operators import communities, discovery, evaluation, graph, ingest, matching, quality, retrieval, running, similarity, temporal, trends


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_merges_maps(spark):
    old = spark.createDataFrame([("a", {"x": "1", "keep": "k"}), ("b", {"x": "2"})], "id string, snapshot map<string,string>")
    new = spark.createDataFrame([("a", {"x": "9"}), ("c", None)], "id string, snapshot map<string,string>")
    got = {r.id: r.snapshot for r in ingest.upsert(old, new, ["id"], "snapshot").collect()}
    assert got == {"a": {"x": "9", "keep": "k"}, "b": {"x": "2"}, "c": {}}
    assert {r.id: r.snapshot for r in ingest.upsert(old, new, ["id"]).collect()}["a"] == {"x": "9"}


def test_accepted_and_renames(spark):
    items = spark.createDataFrame([("Cook", None, "d" * 60), ("Intern", None, "d" * 60), ("Java/Go/C", None, "d" * 60), ("Cook", None, "short")], "title string, tags array<string>, description string").withColumns({"requirements": F.lit(None).cast("string"), "raw_text": F.lit("")})
    assert [r.description for r in ingest.accepted(items).collect()] == ["d" * 60]
    plan = ingest.rename_plan(spark.createDataFrame([("高级工程师",), ("工程师",), ("资深厨师",)], "name string"), "name")
    assert rows(plan) == [("资深厨师", "厨师", False), ("高级工程师", "工程师", True)]
    skills = spark.createDataFrame([(1, 2, "python"), (1, 1, "Python"), (1, 3, "金融"), (2, 1, "前端开发")], "id int, seq int, name string")
    assert rows(ingest.post_processed(skills, "id").select("id", "name")) == [(1, "Python"), (2, "前端")]


def test_trends_of_short_and_flat_series(spark):
    f = spark.createDataFrame([("one", "1", 50), ("flat", "1", 20), ("flat", "2", 20), ("spike", "1", 20), ("spike", "2", 21), ("spike", "3", 90), ("few", "1", 3), ("few", "2", 9)], "k string, p string, freq long")
    got = {r.k: r for r in trends.trend_signals(f, "k", "p").collect()}
    assert set(got) == {"flat", "spike", "few"}
    assert (got["flat"].z, got["flat"].trend, got["flat"].confidence) == (0.0, "stable", 0.0)
    assert (got["spike"].trend, got["spike"].confidence) == ("emerging", 1.0)
    assert (got["few"].z, got["few"].trend) == (None, "protected")
    weekly = spark.createDataFrame([("a", "s", "1", 5), ("b", "s", "1", 5), ("b", "s", "2", 5), ("c", "s", "1", 5), ("c", "s", "2", 9), ("d", "s", "1", 5), ("d", "s", "2", 1)], "skill string, source string, week string, cnt long")
    assert [(r[0], r[2], r[3]) for r in rows(trends.watch_z(weekly))] == [("a", None, False), ("b", 0.0, False), ("c", 2.0, True), ("d", -2.0, False)]
    months = spark.createDataFrame([("x", f"{i:02d}", 1 if i < 13 else 30) for i in range(1, 14)] + [("y", f"{i:02d}", 1) for i in range(1, 13)], "skill string, p string, freq long")
    got = {r.skill: r for r in trends.average_growth(months, "skill", "p").collect()}
    assert got["x"].hit
    assert got["y"].growth is None
    s = spark.createDataFrame([([4.0, 1.0, 2.0],), ([],), ([0.0, 0.0],), ([5.0],)], "f array<double>")
    assert [r[0] for r in s.select(trends.volatility(F.col("f"))).collect()] == [0.5, 0.0, 0.0, 0.0]
    assert [r[0] for r in s.select(trends.decline_rate(F.col("f"))).collect()] == [0.5, 0.0, 0.0, 0.0]
    signals = trends.watch_signals(trends.watch_z(weekly), spark.createDataFrame([("q", "boss", 0.7, True)], "skill string, source string, growth double, hit boolean"), ["boss"])
    assert {r.kind for r in signals.collect()} == {"z", "jd_growth"}


def zombie_truth(data, similar=0.95):
    out = []
    for i, p, d, s in data:
        others = sorted(((x[2], x[0], set(x[3])) for x in data if x[1] == p and x[0] != i), reverse=True)
        n = 1
        for _, _, o in others:
            if len(o & set(s)) / len(o | set(s)) < similar:
                break
            n += 1
        out.append((i, p, n))
    return sorted(out, key=str)


def test_zombies(spark):
    import random

    rng = random.Random(3)
    for _ in range(2):
        big = [f"s{i:03d}" for i in range(50)]
        data = [(i, f"p{i % 3}", dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(20)), sorted(rng.choice([["a"], ["a"], ["a", "b"], big, big[:49], [*big[:48], "x"]]))) for i in range(80)]
        df = spark.createDataFrame(data, "id int, position_name string, publish_date date, skills array<string>")
        assert rows(temporal.zombies(df)) == zombie_truth(data)


def test_sai_without_recent_ads(spark):
    d = spark.createDataFrame([(1, "p", "a", dt.date(2020, 1, 1)), (2, "q", "a", dt.date(2024, 1, 1)), (3, "q", "b", dt.date(2024, 1, 1))], "id int, position_name string, skill string, publish_date date")
    as_of = F.to_date(F.lit("2024-01-01"))
    got = {r.id: r for r in temporal.sai(temporal.first_seen(d, as_of), as_of).collect()}
    assert (got[1].sai, got[2].sai) == (0.0, 0.0)


def test_quality_operators(spark):
    empty = spark.createDataFrame([], "fingerprint string")
    assert rows(quality.dedup_stats(empty)) == [(0, 0, 0, 0.0)]
    some = spark.createDataFrame([("a",), ("a",), (None,), ("",)], "fingerprint string")
    assert rows(quality.dedup_stats(some)) == [(4, 1, 3, 0.75)]
    assert rows(quality.source_distribution(spark.createDataFrame([("x",), (" ",), (None,)], "source string"))) == [("unknown", 2), ("x", 1)]
    f = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("b", None)], "source string, crawled_at timestamp")
    assert rows(quality.freshness(f, F.to_timestamp(F.lit("2024-01-02")))) == [("a", 1.0, True), ("b", None, False)]


def test_fingerprint_pairs(spark):
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(4)] + base[:3] * 2
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id long, simhash long")
    d = sorted(set(signed))
    for t in (1, 3, 6):
        want = [(a, b, (a ^ b).bit_count() if (a ^ b) >= 0 else ((a ^ b) + (1 << 64)).bit_count()) for i, a in enumerate(d) for b in d[i + 1 :]]
        assert rows(similarity.near_fingerprints(df, t)) == sorted((x for x in want if x[2] <= t), key=str)
    low = [min(j for j, q in enumerate(prints) if (p ^ q).bit_count() <= 3) for p in prints]
    assert [r.duplicate_of for r in similarity.near_documents(df, "doc_id").orderBy("doc_id").collect()] == [x if x < i else None for i, x in enumerate(low)]


def test_alignment(spark):
    v = spark.createDataFrame([(1, "Data Engineer", ["DE x", "ab"]), (2, "Cook", None)], "code int, name string, aliases array<string>")
    n = spark.createDataFrame([("cook",), ("Senior DE X",), ("lab",), ("none",)], "name string")
    assert rows(similarity.aligned(n, v)) == [("Senior DE X", 1, 1.0), ("cook", 2, 1.0)]


def edges(spark, pairs):
    e = spark.createDataFrame([(a, b) for a, b in pairs], "a string, b string")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def test_graph_algorithms(spark):
    star = edges(spark, [("c", x) for x in "defg"])
    rank = {r.id: r.rank for r in graph.pagerank(star).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-6
    assert max(rank, key=rank.get) == "c"
    assert graph.pagerank(star.limit(0)).collect() == []
    two = [(a, b, 1.0) for g in ("abc", "xyz") for a in g for b in g if a < b] + [("c", "x", 0.1)]
    pairs = spark.createDataFrame(two, "a string, b string, weight double")
    assert rows(graph.clusters(communities.louvain(pairs)).select("members")) == [(["a", "b", "c"],), (["x", "y", "z"],)]
    assert graph.modularity(pairs, communities.louvain(pairs).select("id", "community")).first().q > 0.4
    path = edges(spark, [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e")])
    assert graph.shortest_path(path, "a", "e").collect()[0].path == ["a", "b", "c", "e"]
    assert graph.shortest_path(path, "a", "a").collect()[0].path == ["a"]
    assert graph.shortest_path(path, "a", "nowhere").collect() == []
    assert graph.shortest_path(path, "a", "e", hops=2).collect() == []
    pre = spark.createDataFrame([("ml", "math"), ("ml", "python"), ("math", "logic"), ("logic", "math")], "src string, dst string")
    got = {r.skill: r.chain for r in graph.chain_order(pre, spark.createDataFrame([("ml",)], "skill string")).collect()}
    assert got == {"ml": ["logic", "math", "python"]}


def test_graph_upkeep(spark):
    v = spark.createDataFrame([(1, "x", None), (1, "", "d"), (2, "y", "e")], "id int, name string, note string").withColumn("t", F.col("id"))
    assert rows(graph.merged_vertices(v, "id", F.col("t"), ["name", "note"])) == [(1, "x", "d"), (2, "y", "e")]
    e = spark.createDataFrame([("a", "b", "old"), ("a", "b", "new")], "src string, dst string, type string")
    assert rows(graph.relabelled(e, "old", "new")) == [("a", "b", "new")]
    nodes, links = graph.exported(spark.createDataFrame([("1", "Skill", ""), (None, "Skill", "x"), ("2", "Counter", "c")], "id string, label string, name string"), e, ["Counter"])
    assert rows(nodes) == [("1", "1", "Skill")]
    assert len(rows(links)) == 2


def test_snapshots_replace_only_their_versions(spark, tmp_path):
    p = str(tmp_path / "snap")
    make = lambda v, n: spark.createDataFrame([(v, str(i)) for i in range(n)], "version string, id string")
    graph.write_snapshot(make("v1", 2).unionByName(make("v2", 2)), p)
    graph.write_snapshot(make("v2", 5), p)
    assert {r.version: r["count"] for r in spark.read.parquet(p).groupBy("version").count().collect()} == {"v1": 2, "v2": 5}


def test_discovery(spark):
    ch = spark.createDataFrame([("candidate", "emerging", "auto", None), ("stable", "archived", "auto", None), ("declining", "archived", "admin", " "), ("declining", "archived", "admin", "gone")], "state string, target string, operator string, reason string")
    assert sorted((r.state, r.target, r.reason, r.legal) for r in discovery.legal(ch).collect() if r.legal) == [("candidate", "emerging", None, True), ("declining", "archived", "gone", True)]
    old = spark.createDataFrame([("a", "stable", 0.9, None), ("b", "candidate", 0.1, 2.0)], "position_name string, state string, confidence double, jd_freq_ma3 double")
    new = spark.createDataFrame([("a", "candidate", 0.5, 1.0), ("b", "candidate", 0.7, None), ("c", "candidate", 0.6, None)], "position_name string, state string, confidence double, jd_freq_ma3 double")
    assert rows(discovery.upserted(old, new)) == [("a", "stable", 0.5, 1.0), ("b", "candidate", 0.7, 2.0), ("c", "candidate", 0.6, 0.0)]
    seeds = spark.createDataFrame([(1, "llm", ["Prompt"], "about prompts")], "seed_order int, seed string, terms array<string>, description string")
    vocab = spark.createDataFrame([("15", "Prompt Engineer", "writes prompts")], "code string, name string, definition string")
    names = spark.createDataFrame([("Prompt Engineer",), ("Prompt",), ("Cook",)], "name string")
    got = {r.name: (r.seed, r.code, r.draft) for r in discovery.grounded(names, seeds, vocab).collect()}
    assert got["Prompt Engineer"] == ("llm", "15", "writes prompts")
    assert got["Cook"] == (None, None, None)
    f = spark.createDataFrame([("x", 20, 3, 2.5, 12.0, 0.5, 90, 1, 1, True, False), ("y", 20, 3, None, 12.0, 0.5, 90, 1, 1, True, False)], "position_name string, jd_count long, sources long, z double, ma3 double, growth double, history int, successes long, trials long, arxiv boolean, github boolean")
    assert [(r.position_name, round(r.confidence, 3)) for r in discovery.candidates(f).collect()] == [("x", 1.0)]


def test_matching(spark):
    p = spark.createDataFrame([("p", "a", "must", 1.0, "高级", 1), ("p", "b", "must", 1.0, None, 1), ("p", "c", "nice", 0.5, None, 1), ("q", "z", "must", 1.0, None, 1), ("r", "a", "nice", 1.0, None, 1)], "position_name string, skill string, necessity string, weight double, proficiency string, source_count int")
    c = spark.createDataFrame([(1, "a", 1, False), (1, "c", 2, True)], "candidate int, skill string, proficiency int, low_confidence boolean")
    years = spark.createDataFrame([(1, 2.0)], "candidate int, total_years double")
    meta = spark.createDataFrame([("p", 4.0, 1.0), ("q", None, None)], "position_name string, required_years double, staleness double")
    chosen = spark.createDataFrame([(1, "p"), (1, "q"), (1, "r")], "candidate int, position_name string")
    got = {r.position_name: r for r in matching.scores(c, years, p, meta, chosen).collect()}
    assert (got["p"].must_score, got["p"].nice_score, got["p"].exp_score) == (0.5, 0.5, 0.5)
    assert (got["q"].total_score, got["q"].unqualified) == (0.0, True)
    assert (got["r"].must_score, got["r"].unqualified) == (1.0, False)
    near = spark.createDataFrame([("b", "a", 0.9)], "skill string, other string, sim double")
    assert {r.position_name: r.must_score for r in matching.scores(c, years, p, meta, chosen, near=near).collect()}["p"] == 0.95
    gap = {r.skill: (r.gap, r.priority) for r in matching.gaps(c, p, chosen.where("position_name = 'p'")).collect()}
    assert gap == {"a": ("weak", "medium"), "b": ("missing", "high"), "c": ("matched", "low")}
    many = spark.createDataFrame([("p", f"s{i}", "must", float(i), "专家" if i == 0 else None, 30 if i == 0 else 1) for i in range(10)], p.schema)
    assert sorted(r.skill for r in matching.cii_corrected(many).where("demoted").collect()) == ["s1", "s2"]
    parsed = spark.createDataFrame([(1, ["Go", '{"name": "Rust", "proficiency": 3}'])], "candidate int, skills array<string>")
    assert rows(matching.candidate_skills(parsed)) == [(1, "Go", 2, False), (1, "Rust", 3, False)]
    req = matching.position_requirements(p.select("position_name", "skill", "necessity", F.lit(None).cast("double").alias("weight"), "proficiency", "source_count").limit(1), spark.createDataFrame([("p", ["沟通能力"])], "position_name string, soft_skills array<string>"))
    assert sorted(r.weight for r in req.collect()) == [0.4, 1.0]
    a, b = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 2.0])], "candidate int, vector array<double>"), spark.createDataFrame([("p", [3.0, 0.0])], "position_name string, vector array<double>")
    assert matching.project_score(a, b, spark.createDataFrame([(1, "p"), (2, "p")], "candidate int, position_name string")).first().score == 0.5
    ids = matching.courses_of_skills(spark.createDataFrame([("i", "a"), ("j", "b")], "skill_id string, skill string"), spark.createDataFrame([("i", "c1", 1.0)], "skill_id string, course string, score double"), spark.createDataFrame([("a", "c1", 1.0), ("b", "c2", None)], "skill string, course string, score double"))
    assert rows(ids) == [("a", "c1", 1.0), ("b", "c2", None)]


def test_retrieval(spark):
    hits = spark.createDataFrame([("q", "a", 0.9, 50), ("q", "b", 0.8, 60), ("q", "c", 0.7, 30), ("q", "a", 0.1, 50), ("q", "d", 0.6, 20), ("q", "big", 2.0, 999)], "g string, k string, score double, n long")
    assert [(r.k, r["rank"]) for r in retrieval.within_budget(hits, "g", "k", "n", 100, 3).collect()] == [("a", 1), ("c", 2), ("d", 3)]
    assert [r.k for r in retrieval.ranked(hits.select("g", "k", "score").distinct(), "g", "k", 2).orderBy("rank").collect()] == ["big", "a"]


def test_evaluation(spark):
    s = lambda r: spark.createDataFrame(r, "pred array<string>, gold array<string>")
    assert tuple(evaluation.f1(s([(["Java", "go"], ["java", "rust"])])).first()) == (1, 0, 1, 1.0, 0.5, 2 / 3)
    assert tuple(evaluation.f1(s([])).first())[3:] == (0.0, 0.0, 0.0)
    k = lambda r: evaluation.kappa(spark.createDataFrame(r, "a double, b double"), "a", "b").first()[0]
    assert (k([(1.0, 1.0)]), k([(1.0, 1.0), (1.0, 1.0)]), k([(1.0, 0.0), (0.0, 1.0)])) == (0.0, 1.0, -1.0)
    assert evaluation.weights_of({"a": "x"}, {"a": 1.0}) == {"a": 1.0}
    assert evaluation.weights_of({"a": 2}, {"a": 1.0}) == {"a": 2.0}
    assert evaluation.weights_of({"a": -2}, {"a": 1.0}) == {"a": 1.0}


def test_running_sums(spark):
    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "k long, v long")
    got = {r.k: r.s for r in running.running_sum(df, "k", F.col("v"), "s").collect()}
    total = 0
    for k, v in sorted((i * 7 % 101, i) for i in range(101)):
        total += v
        assert got[k] == total
    assert running.numbered(df.limit(0), "k", "n").collect() == []
    assert sorted(r.n for r in running.numbered(df, "k", "n").collect()) == list(range(1, 102))


def chunk_truth(data, size, most):
    out, held, last = [], {}, {}
    for k, o, t in sorted(data, key=lambda x: (x[0] is not None, x[0] or "", x[1])):
        n = len(t or "")
        if k not in held:
            held[k], last[k] = (1, n), 0
        elif held[k][0] >= size or held[k][1] + n > most:
            held[k], last[k] = (1, n), last[k] + 1
        else:
            held[k] = (held[k][0] + 1, held[k][1] + n)
        out.append((k, o, last[k]))
    return sorted(out, key=str)


def test_chunks_across_blocks(spark, monkeypatch):
    import random

    rng = random.Random(2)
    data = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, "", "x" * rng.randrange(40), "y" * 200])) for i in range(300)]
    df = spark.createDataFrame(data, "source string, doc_id long, text string")
    for size, most, block in ((3, 60, 7), (5, 1000, 5), (4, 30, 1000), (1, 10, 2)):
        assert rows(ingest.chunks(df, "source", "doc_id", "text", size, most, block)) == chunk_truth(data, size, most)
    assert ingest.chunks(df.limit(0), "source", "doc_id", "text", 3, 60).collect() == []
    monkeypatch.setattr(ingest, "FAN_IN", 3)
    assert rows(ingest.chunks(df, "source", "doc_id", "text", 3, 60, 7)) == chunk_truth(data, 3, 60)


def test_rough_selection_is_the_same_with_many_positions(spark, monkeypatch):
    c = spark.createDataFrame([(i, f"s{(i * j) % 9}") for i in range(12) for j in range(5)], "candidate int, skill string")
    p = spark.createDataFrame([(f"p{i}", f"s{(i + j) % 9}") for i in range(8) for j in range(3)], "position_name string, skill string")
    few = rows(matching.rough_select(c, p, 3).select("candidate", "position_name", "hits"))
    monkeypatch.setattr(matching, "FEW_POSITIONS", 0)
    assert rows(matching.rough_select(c, p, 3).select("candidate", "position_name", "hits")) == few


def test_budget_of_hits(spark):
    hits = spark.createDataFrame([("q", 1, 9.0, 60), ("q", 2, 8.0, 50), ("q", 3, 7.0, 40), ("q", 4, 7.0, 1), ("q", 4, 6.0, 1), ("r", 1, 1.0, 101)], "g string, k long, score double, tokens long")
    assert rows(retrieval.within_budget(hits, "g", "k", "tokens", 100, 3).select("g", "k", "rank")) == [("q", 1, 1), ("q", 3, 2)]
    assert rows(retrieval.within_budget(hits, "g", "k", "tokens", 101, 5).select("g", "k", "rank")) == [("q", 1, 1), ("q", 3, 2), ("q", 4, 3), ("r", 1, 1)]
    assert retrieval.within_budget(hits.limit(0), "g", "k", "tokens", 100, 3).collect() == []


def test_pagerank_against_a_matrix(spark):
    import numpy as np

    e = [(a, b) for a, b in (("x", "y"), ("x", "z"), ("y", "z"), ("z", "w"))]
    both = e + [(b, a) for a, b in e]
    ids = sorted({a for a, _ in both})
    m = np.array([[((b, a) in both) / sum(x == b for x, _ in both) for b in ids] for a in ids])
    r = np.full(len(ids), 1 / len(ids))
    for _ in range(50):
        new = 0.15 / len(ids) + 0.85 * m @ r
        done = abs(new - r).max() < 1e-6
        r = new
        if done:
            break
    got = {x.id: x["rank"] for x in graph.pagerank(spark.createDataFrame(both, "a string, b string")).collect()}
    assert all(abs(got[i] - v) < 1e-9 for i, v in zip(ids, r, strict=True))


def test_work_folders_without_a_setting(spark, monkeypatch):
    from skillweft.sources import staging

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, folder = "local[2]", None

        def getCheckpointDir(self):  # noqa: N802
            return self.folder

        def setCheckpointDir(self, path):  # noqa: N802
            self.folder = path

    class Session:
        conf, sparkContext = Conf(), Context()

    one, two = staging.shared_path(Session(), "a"), staging.shared_path(Session(), "a")
    assert one != two
    assert one.rpartition("/")[0] == two.rpartition("/")[0]
    Session.sparkContext.folder, Session.sparkContext.master = None, "spark://x"
    try:
        staging.shared_path(Session(), "a")
    except ValueError as e:
        assert "spark.checkpoint.dir" in str(e)
    else:
        raise AssertionError("a folder of one machine was taken")
