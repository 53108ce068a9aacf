"""Candidates meet every position that they share a skill with."""

import datetime

import pytest

from pyspark.sql import functions as F

from skillweft.operators import matching
from skillweft.plans import registry

QUERIES = registry()[0]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Customer 0 has all skills of A/N0 (three) and of A/N6 (one), and two of eight of the five positions between them, which have more of its skills than A/N6."""
    brands = {0: "B1 B2 B9", 6: "B9"} | {i: "B1 B2 B3 B4 B5 B6 B7 B8" for i in range(1, 6)}
    orders = [(10 * (2 * c + i), c) for c in range(7) for i in range(1 if c == 6 else 2)]
    lines = [(o, int(b[1:]), n, "R", "F", 20.0) for o, c in orders for n, b in enumerate(brands[c].split())]
    tables = {
        "nation": ([(i, f"N{i}") for i in range(7)], "n_nationkey int, n_name string"),
        "customer": ([(i, i, "A") for i in range(7)], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "part": ([(i, f"B{i}") for i in range(1, 10)], "p_partkey long, p_brand string"),
        "orders": ([(o, c, datetime.datetime(2000, 1, 1), "1", 1.0) for o, c in orders], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string, o_totalprice double"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double"),
    }
    d = tmp_path_factory.mktemp("matching")
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return str(d)


def test_every_pair_is_scored(spark, small):
    got = {(r.candidate, r.position_name): r.must_score for r in QUERIES["match_scores"](spark, small).collect()}
    near = [(a, f"A/N{b}") for a in range(6) for b in range(6)]
    assert sorted(got) == sorted([*near, (0, "A/N6"), (6, "A/N0"), (6, "A/N6")])
    assert got[0, "A/N6"] == got[0, "A/N0"] == 1.0 > got[0, "A/N1"]


def test_all_pairs_are_those_with_a_common_skill(spark, monkeypatch):
    c = [(a, f"s{(a * 7 + i * i) % 97}", 2, i % 2 == 0) for a in range(25) for i in range(8)] + [(90, "elsewhere", 1, False), (91, None, 1, False)]
    p = [(f"p{a}", f"s{(a * 11 + i) % 97}", ("must", "nice", None)[i % 3], float(i % 4), None, i) for a in range(20) for i in range(9)] + [("none", "nowhere", "must", 1.0, None, 1), ("only null", None, "must", 1.0, None, 1), (None, "s5", "must", 1.0, None, 1)]
    has, of = ({k: {r[1] for r in rows if r[0] == k and r[1]} for k in {r[0] for r in rows}} for rows in (c, p))
    pairs = sorted((a, b) for a in has for b in of if b and has[a] & of[b])
    assert 0 < len(pairs) < len(has) * len(of) / 2
    c = spark.createDataFrame(c, "candidate int, skill string, proficiency int, low_confidence boolean")
    p = spark.createDataFrame(p, "position_name string, skill string, necessity string, weight double, proficiency string, source_count int")
    years, meta = spark.createDataFrame([(1, 2.0)], "candidate int, total_years double"), spark.createDataFrame([("p1", 4.0, 0.9)], "position_name string, required_years double, staleness double")
    near = spark.createDataFrame([("s1", "s2", 0.75), ("s4", "elsewhere", 0.5)], "skill string, other string, sim double")
    rows = lambda df: sorted(tuple(r) for r in df.select("candidate", "position_name", "must_score", "nice_score", "total_score", "unqualified", F.concat_ws(",", "missing_must")).collect())
    chosen = spark.createDataFrame(pairs, "candidate int, position_name string")
    for like in (None, near):
        want = rows(matching.scores(c, years, p, meta, chosen, near=like))
        assert [r[:2] for r in want] == pairs
        assert rows(matching.scores(c, years, p, meta, near=like)) == want
        with monkeypatch.context() as m:
            m.setattr(matching, "FEW_SKILLS", 0)
            assert rows(matching.scores(c, years, p, meta, near=like)) == want
            m.setattr(matching, "FEW_SKILLS", 256)
            m.setattr(matching, "SKILLS_A_TASK", 20)
            m.setattr(matching, "FEW_TERMS", 0)
            assert rows(matching.scores(c, years, p, meta, near=like)) == want


def test_the_best_are_those_of_all_positions(spark, small):
    got = {(r.candidate, r.rank): (r.position_name, r.missing) for r in QUERIES["match_topn"](spark, small).collect()}
    assert got[0, 1] == ("A/N0", "") and got[0, 2] == ("A/N6", "")
    assert got[6, 1] == ("A/N6", "") and got[6, 2] == ("A/N0", "B1,B2")
    assert sorted(got) == [(a, r) for a in range(7) for r in (1, 2)]


def test_a_positive_among_all_positions_counts(spark, small):
    assert [tuple(r) for r in QUERIES["top3"](spark, small).collect()] == [(1, 1.0)]  # A/N6, which fewest skills lead to, has the only odd number of ads
