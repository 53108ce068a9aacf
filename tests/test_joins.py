"""Neighbour, substring and cluster joins against brute force, with small chunks, copies, zeros, nulls and extreme numbers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillweft.operators import clusters, communities, discovery, graph, nearest, substring
from skillweft.sources.staging import shared_path, staged


def unit(x):
    x = np.asarray(x, float)
    x = x / (np.abs(x).max() or 1.0)
    return x / (np.sqrt(x @ x) or 1.0)


def usable(x):
    return x and all(y is not None and np.isfinite(y) for y in x)


VECTORS = [(i, [float(x) for x in np.random.default_rng(i).normal(size=3 + i % 2)]) for i in range(50)]
VECTORS += [(90, [0.0] * 3), (91, None), (92, [float("nan"), 1.0, 2.0]), (93, [1e200, 1e200, 0.0]), (94, [1e200, 1.01e200, 0.0]), (95, [1e-200, 1e-200, 0.0]), (96, []), (97, [None, 1.0, 1.0])]
VECTORS += [(100 + i, [1.0, 2.0, 3.0]) for i in range(7)]


@pytest.mark.parametrize(("least", "k", "strict", "other"), [(0.5, 1, False, False), (0.5, 3, False, True), (0.0, 4, False, True), (-1.0, 2, False, False), (0.0, 3, True, False)])
def test_nearest(spark, monkeypatch, least, k, strict, other):
    monkeypatch.setattr(nearest, "CHUNK_BYTES", 300)
    monkeypatch.setattr(nearest, "LANE_ROWS", 9)
    df = spark.createDataFrame(VECTORS, "id long, vector array<double>")
    want = []
    for a, x in VECTORS:
        near = []
        for b, y in VECTORS:
            if usable(x) and usable(y) and len(x) == len(y) and (a != b or not other):
                c = float(unit(x) @ unit(y))
                if c > least + 1e-12 if strict else c >= least - 1e-12:
                    near.append((-round(c, 9), b))
        want += [(a, b, i) for i, (_, b) in enumerate(sorted(near)[:k], 1)]
    got = nearest.nearest(df, df, least, k, strict, other)
    assert sorted((r.a, r.b, r["rank"]) for r in got.collect()) == sorted(want)


def test_nearest_of_nothing(spark):
    some, none = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<double>"), spark.createDataFrame([], "id long, vector array<double>")
    for left, right in ((some, none), (none, some), (none, none)):
        assert nearest.nearest(left, right, 0.5, 2).collect() == []
        assert nearest.nearest(left, right, -1.0, 2).collect() == []


def test_few_rows_are_sent_where_vectors_have_structure(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 2000)] + 0.05 * rng.normal(size=(2000, 16))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>")
    work = shared_path(spark, "t")
    units = staged(nearest.unit_rows(df), f"{work}/u")
    cells = nearest.Cells(units, work)
    visits = cells.visits(units, float(np.sqrt(2 - 2 * 0.9)), False, False)
    met = visits.select("size", F.explode("cells").alias("cell")).join(cells.rows.groupBy("size", "cell").agg(F.count("*").alias("n")), ["size", "cell"]).agg(F.sum("n")).first()[0]
    assert met < 0.1 * 2000 * 2000
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {r.a: (r.b, r.score) for r in nearest.nearest(df, df, 0.9, 1, other=True).collect()}
    assert all(got[i][0] == s[i].argmax() and abs(got[i][1] - s[i].max()) < 1e-12 for i in range(2000) if s[i].max() >= 0.9)
    assert len(got) == int((s.max(1) >= 0.9).sum())


TEXTS = ["人工智能算法工程师", "senior data engineer", "lab", "ab", "数据", "高级数据分析师", "", None, "a%b", "工程", "aaaa", "lab"]
NEEDLES = ["算法工程师", "engine", "ab", "数据", "工程", "a", "%", "x", None, "", "data eng", "智能算", "aaa", "ab", "不在"]


@pytest.mark.parametrize("most", [50_000, 0])
def test_substrings(spark, monkeypatch, most):
    monkeypatch.setattr(substring, "AUTOMATON_NEEDLES", most)
    t, n = spark.createDataFrame([(x,) for x in TEXTS], "text string"), spark.createDataFrame([(x,) for x in NEEDLES], "needle string")
    want = sorted({(x, y) for x in TEXTS for y in NEEDLES if x and y and y in x})
    assert sorted(map(tuple, substring.holds(t, n).collect())) == want
    assert substring.holds(t, n.limit(0)).collect() == substring.holds(t.limit(0), n).collect() == []
    plan = substring.holds(t, n)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_names_of_a_vocabulary(spark):
    rows = spark.createDataFrame([(1, "Uses K8S and 数据分析平台"), (2, None), (3, ""), (1, "golang")], "doc_id long, text string")
    terms = [("k8s", "Kubernetes"), ("数据分析", "数据分析"), ("Go", "Go"), ("golang", "Go"), ("", "x"), ("uses", "U"), ("uses", "V")]
    got = sorted((r.doc_id, r.names) for r in substring.names_in(rows, "doc_id", "text", terms).collect())
    assert got == [(1, ["Go"]), (1, ["Kubernetes", "U", "V", "数据分析"]), (2, []), (3, [])]
    assert [r.names for r in substring.names_in(rows, "doc_id", "text", []).collect()] == [[]] * 4


def test_grounding_without_spaces(spark):
    vocabulary = spark.createDataFrame([("2", "人工智能算法工程师", "trains", None), ("1", "Lead", "leads", ["senior data engineer"]), ("3", "data engineering", "pipes", None)], "code string, name string, definition string, aliases array<string>")
    names = spark.createDataFrame([("算法工程师",), ("Engine",), ("data",), ("ai",), (" ",)], "name string")
    seeds = spark.createDataFrame([(1, "s", ["算法"], "seed")], "seed_order int, seed string, terms array<string>, description string")
    got = {r.name: (r.seed, r.code, r.draft) for r in discovery.grounded(names, seeds, vocabulary).collect()}
    assert got == {"算法工程师": ("s", "2", "trains"), "Engine": (None, "3", "pipes"), "data": (None, "3", "pipes"), "ai": (None, None, None), " ": (None, None, None)}
    v = spark.createDataFrame([("data", [1.0, 0.1]), ("1", [1.0, 0.0]), ("2", [0.0, 1.0])], "id string, vector array<double>")
    hits = {(r.name, r.code): round(r.score, 3) for r in discovery.authoritative(names, vocabulary, v).collect()}
    assert hits[("data", "1")] == 0.995 and hits[("data", "3")] == 1.0 and hits[("data", "2")] == 0.1


def first_fit(names, vectors, least):
    """The rule itself: a name joins the first cluster with any member that is near enough."""
    found: list[list[int]] = []
    u = {n: unit(v) for n, v in vectors.items() if usable(v)}
    for n in names:
        home = next((c for c in found if any(n in u and m in u and len(u[n]) == len(u[m]) and u[n] @ u[m] >= least for m in c)), None)
        found.append([n]) if home is None else home.append(n)
    return {n: c[0] for c in found for n in c}


def test_first_fit(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CHUNK_BYTES", 2000)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 6))
    vectors = {i: (base[rng.integers(12)] + rng.normal(size=6) * 0.4).tolist() for i in range(150)}
    vectors |= {200: None, 201: [0.0] * 6, 202: vectors[3], 203: vectors[3], 204: [1.0, 2.0], 205: [1.0, 2.1]}
    df = spark.createDataFrame(list(vectors.items()), "id long, vector array<double>")
    got = {r.id: r.label for r in clusters.first_fit(df, 0.75).collect()}
    assert got == first_fit(sorted(vectors), vectors, 0.75)
    assert len(set(got.values())) > 5


def test_ten_thousand_names(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(800, 12))
    x = base[rng.integers(0, 800, 10_000)] + rng.normal(size=(10_000, 12)) * 0.35
    rows = [(f"n{i:05d}", i, int(rng.integers(1, 9)), r.tolist()) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "name string, seq long, cnt long, vector array<double>")
    got = {r.name: (r.standard, r.confidence) for r in clusters.normalize_clusters(df.drop("vector"), df.select("name", "vector"), 0.8).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.arange(len(u))
    for i in range(1, len(u)):
        near = np.flatnonzero(u[:i] @ u[i] >= 0.8)
        if len(near):
            label[i] = label[near].min()
    want = {}
    for c in np.unique(label):
        members = np.flatnonzero(label == c)
        top = max(members, key=lambda i: (rows[i][2], -i))
        sims = [float(u[i] @ u[top]) for i in members if i != top]
        want |= {rows[i][0]: (rows[top][0], sum(sims) / len(sims) if sims else 1.0) for i in members}
    assert {n: s for n, (s, _) in got.items()} == {n: s for n, (s, _) in want.items()}
    assert all(abs(got[n][1] - want[n][1]) < 6e-5 for n in want)


def test_louvain(spark):
    cliques = [(f"n{i}", f"n{j}", 1.0) for c in range(3) for i in range(4 * c, 4 * c + 4) for j in range(i + 1, 4 * c + 4)] + [("n3", "n4", 0.1), ("n7", "n8", 0.1)]
    got = {r.id: r.community for r in communities.louvain(spark.createDataFrame(cliques, "a string, b string, weight double")).collect()}
    assert set(got.values()) == {0, 1, 2}
    assert all(got[f"n{i}"] == got[f"n{4 * (i // 4)}"] for i in range(12))
    none = spark.createDataFrame([], "a string, b string, weight double")
    assert communities.louvain(none).collect() == []
    rng = random.Random(3)
    planted = [(f"n{i}", f"n{j}", 1.0) for i in range(120) for j in range(i + 1, 120) if rng.random() < (0.4 if i // 20 == j // 20 else 0.01)]
    df = spark.createDataFrame(planted, "a string, b string, weight double")
    found = staged(communities.louvain(df), shared_path(spark, "t"))
    known = found.select("id", (F.substring("id", 2, 9).cast("int") / 20).cast("long").alias("community"))
    assert graph.modularity(df, found).first().q >= 0.99 * graph.modularity(df, known).first().q
