"""What is sent, compared or held grows no faster than the input."""

import math
import re

import numpy as np

from pyspark.sql import functions as F

from skillweft.operators import clusters, evaluation, inverted, matching, nearest, records, similarity
from skillweft.plans import views
from skillweft.sources.staging import shared_path, staged


def test_a_long_chain_of_names_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CHUNK_BYTES", 1024)
    rounds, compared = [], nearest.Cells.compared
    monkeypatch.setattr(nearest.Cells, "compared", lambda self, *a, **k: rounds.append(1) or compared(self, *a, **k))
    at = [0.0, *(3.0 + 0.01 * i for i in range(150))]  # the first one is alone, each other one is near the one before
    df = spark.createDataFrame([(i, [math.cos(a), math.sin(a)]) for i, a in enumerate(at)], "id long, vector array<double>")
    got = {r.id: r.label for r in clusters.first_fit(df, math.cos(0.015)).collect()}
    assert got == {i: min(i, 1) for i in range(151)}
    assert len(rounds) <= 12


def test_a_query_is_sent_once_to_each_place(spark):
    x = np.random.default_rng(1).normal(size=(900, 8))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>")
    work = shared_path(spark, "t")
    units = staged(nearest.unit_rows(df), f"{work}/u")
    cells = nearest.Cells(units, work)

    def count(left, _x, _right, _y):
        return nearest.pa.RecordBatch.from_arrays([left.column("id").combine_chunks()], names=["id"])

    out = cells.compared(cells.visits(units, 2.0, False, False), count, "id long")
    assert out.count() == 900 and len(cells.pivots[8]) > 20


def test_a_row_of_the_ring_is_sent_about_once(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "STRETCH", 40)
    for n in (2, 17, 130):
        rows = {i: {f"s{i % 5}", f"s{i % 7}", "x" if i % 3 else "y"} for i in range(n)}
        ring = spark.createDataFrame([(i, sorted(s), i) for i, s in rows.items()], "id long, s array<string>, at long")
        width = min(16, n - 1)
        found = evaluation._next_on_ring(ring, n, width, 3, 0)
        got = {r.id: [f.id for f in r.found] for r in found.collect()}
        assert got == {i: [j for d in range(1, width + 1) if not rows[i] & rows[j := (i + d) % n]][:3] for i in range(n)}
        assert "Join" not in found._jdf.queryExecution().toString()


def test_postings_are_shuffled_once(spark, tmp_path, monkeypatch):
    plans, write = [], inverted.staged
    monkeypatch.setattr(inverted, "staged", lambda df, path: plans.append(df._jdf.queryExecution().toString()) or write(df, path))
    index = inverted.InvertedIndex(spark, str(tmp_path))
    index.add(spark.createDataFrame([(i, "a b b " + f"w{i}") for i in range(50)] + [(50, None), (51, "")], "id long, text string"), "id", "text", "one")
    assert len(plans) == 1 and "Exchange" not in plans[0]
    rows = spark.read.parquet(f"{tmp_path}/postings")
    assert rows.where("term = 'b'").selectExpr("sum(n)", "max(most)", "min(shortest)").first()[:] == (50, 2, 4)
    assert spark.read.parquet(f"{tmp_path}/statistics").first()[:2] == (52, 200)


def test_texts_are_hashed_once(spark):
    docs = spark.createDataFrame([(3, "a b c d"), (1, "a b c d"), (2, None)], "id long, text string")
    marks = similarity.near_documents(similarity.simhash(docs, "id", "text"), "id")
    assert sorted((r.id, r.duplicate_of) for r in marks.collect()) == [(1, None), (2, None), (3, 1)]
    assert "Arrow" not in marks._jdf.queryExecution().toString()


def test_a_common_name_is_no_window(spark):
    skills = spark.createDataFrame([("k", i, "python" if i % 2 else "Python", i) for i in range(9, 0, -1)], "key string, seq long, name string, proficiency int")
    got = records.resume_skills(skills, spark.createDataFrame([], "key string, name string"), "key")
    assert [(r.name, r.proficiency) for r in got.collect()] == [("Python", 1)]
    assert "Window" not in got._jdf.queryExecution().toString()


def test_tasks_are_as_many_as_the_lines_need(spark, sf, monkeypatch):
    rows = lambda df: sorted(map(tuple, df.collect()))
    one, lines = rows(views.requires(spark, sf)), spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr(views, "LINES_A_TASK", 500)
    held = [r.n for r in views.jd_skill(spark, sf).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(held) > lines / 1000 and max(held) < 1000 and sum(held) == lines
    assert rows(views.requires(spark, sf)) == one


def test_pairs_are_scored_in_their_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    name = lambda i: f"s{i}" if i else None
    c = [(int(a), name(i), 2, bool(rng.integers(2))) for a in range(30) for i in rng.integers(0, 90, 12)] + [(90, "elsewhere", 1, False), (91, None, 1, False)]
    p = [(f"p{a}", name(i), ("must", "nice", None)[rng.integers(3)], None if i % 7 == 0 else float(i % 5), None, 1) for a in range(12) for i in rng.integers(0, 80, 15)]
    p += [("only null", None, "must", 1.0, None, 1), ("weightless", "s3", "nice", 0.0, None, 1), ("twice", "s5", "must", 1.0, None, 1), ("twice", "s5", "must", 2.0, None, 2), (None, "s5", "must", 1.0, None, 1)]
    c = spark.createDataFrame(c, "candidate int, skill string, proficiency int, low_confidence boolean")
    p = spark.createDataFrame(p, "position_name string, skill string, necessity string, weight double, proficiency string, source_count int")
    years, meta = spark.createDataFrame([(1, 2.0)], "candidate int, total_years double"), spark.createDataFrame([("p1", 4.0, 0.9)], "position_name string, required_years double, staleness double")
    near = spark.createDataFrame([("s1", "s2", 0.75), ("s4", "elsewhere", 0.5)], "skill string, other string, sim double")
    chosen = c.select("candidate").distinct().crossJoin(p.select("position_name").distinct())
    chosen = chosen.unionByName(chosen.limit(3))
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    rows = lambda df: sorted((tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect()), key=str)
    few, of = matching.scores(c, years, p, meta, chosen, near=near), matching.rough_select(c, p, 4)
    plan = few._jdf.queryExecution().toString()
    got, best = rows(few), rows(of)
    monkeypatch.setattr(matching, "FEW_SKILLS", 0)
    assert rows(matching.rough_select(c, p, 4)) == best
    many = matching.scores(c, years, p, meta, chosen, near=near)
    assert rows(many) == got and len(got) == 32 * 15
    by_skill = re.compile(r"\[candidate#\d+, skill#\d+\], LeftOuter")
    assert by_skill.search(many._jdf.queryExecution().toString()) and not by_skill.search(plan)
