"""The written index, searches, golden pairs, life cycles and page layout against brute force and on odd rows."""

import hashlib
import random
import shutil

from pyspark.sql import functions as F

from skillweft.functions import vocab as V
from skillweft.operators import evaluation, inverted, layout, retrieval, similarity
from skillweft.streaming import lifecycle


def test_index_equals_a_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 8)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["common"] * 30
    docs = [(i, None if i % 37 == 5 else " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40)))) for i in range(300)] + [(900, "数据分析 w1 w1"), (None, "w1 common")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = inverted.InvertedIndex(spark, str(tmp_path))
    for name in ("a", "b", "a"):
        index.add(df.where((F.col("doc_id") % 2 == 0) == (name == "a")), "doc_id", "text", name)
    known = df.where("doc_id is not null")
    for query in ("w1 common", "common", "w3 w4 w5 nowhere", "数据分析"):
        want = {str(r.doc_id): round(r.score, 9) for r in retrieval.bm25(known, "doc_id", "text", query).collect()}
        assert {r.key: round(r.score, 9) for r in index.scores(query).collect()} == want
        best = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:7]
        assert [(r.key, round(r.score, 9)) for r in index.search(query, 7).collect()] == best
    assert index.search(" ", 3).collect() == index.search("nowhere", 3).collect() == []
    # only the folders of the query's terms are read: the others can go
    bucket = spark.createDataFrame([("w7",)], "w string").select(inverted._bucket(F.col("w"))).first()[0]
    for name in ("a", "b"):
        for d in (tmp_path / "postings" / f"batch={name}").iterdir():
            if d.is_dir() and d.name != f"bucket={bucket}":
                shutil.rmtree(d)
    want = {str(r.doc_id): round(r.score, 9) for r in retrieval.bm25(known, "doc_id", "text", "w7").collect()}
    assert {r.key: round(r.score, 9) for r in index.search("w7", 500).collect()} == want


def test_halving_keeps_the_best(spark):
    rows = spark.createDataFrame([(i, i % 100, i % 100 > 60) for i in range(4000)], "id long, n long, gold boolean")
    points = spark.createDataFrame([(float(x),) for x in range(5, 95, 5)], "least double")
    found = evaluation.successive_halving(rows, points, F.col("n") > F.col("least"), "id").collect()
    best = max(found, key=lambda r: (r.rung, -r["rank"]))
    assert (best.least, best.recall, best.fpr, best.objective) == (60.0, 1.0, 0.0, 1.0)
    assert [sum(r.rung == k for r in found) for k in range(4)] == [18, 6, 2, 1]
    assert evaluation.successive_halving(rows, points.limit(0), F.col("n") > F.col("least"), "id").collect() == []
    one = evaluation.successive_halving(rows.limit(0), points.limit(1), F.col("n") > F.col("least"), "id").collect()
    assert [(r.recall, r.fpr) for r in one] == [(0.0, 0.0)]


def test_golden_pairs(spark):
    rng = random.Random(1)
    have = {f"p{i}": rng.sample([f"s{k}" for k in range(25)], rng.randrange(1, 9)) for i in range(80)}
    have["all"] = [f"s{k}" for k in range(25)]
    df = spark.createDataFrame([*have.items(), ("none", []), ("null", None), (None, ["s1"])], "id string, skills array<string>")
    got = evaluation.golden_pairs(df, "id", "skills", draws=1000).collect()
    assert sorted(r.position for r in got if r.label == 1) == sorted(have)
    for r in got:
        mine, own, seen = set(r.candidate_skills), set(have[r.position]), r.candidate_skills
        assert seen == sorted(mine)
        if r.label:
            assert mine <= own and len(mine) == max(1, int(len(own) * 0.6)) and r.other is None
        else:
            other = set(have[r.other])
            assert r.other != r.position and mine <= other and len(own & other) <= 1 and len(mine) == max(1, int(len(other) * 0.7))
    for p, own in have.items():
        there = sum(o != p and len(set(own) & set(x)) <= 1 for o, x in have.items())
        assert sum(r.position == p and r.label == 0 for r in got) == min(2, there)
    assert evaluation.golden_pairs(df.limit(0), "id", "skills").collect() == []


def test_configured_weights(spark):
    texts = ['{"must": 1, "nice": "2.5", "exp": 0}', '{"must": 1, "nice": 2}', '{"must": -1, "nice": 2, "exp": 3}', '{"must": "x", "nice": 2, "exp": 3}', "no", None, "[]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    got = [tuple(r.w[k] for k in ("must", "nice", "exp")) for r in df.select("i", evaluation.configured_weights(F.col("c"), V.MATCH_WEIGHTS).alias("w")).orderBy("i").collect()]
    default = tuple(float(V.MATCH_WEIGHTS[k]) for k in ("must", "nice", "exp"))
    assert got == [(1.0, 2.5, 0.0)] + [default] * 6


def test_simhash_rule(spark):
    texts = ["", None, "One two two THREE", "数据分析 a", "x " * 70_000 + "y"]
    got = {r.i: r.simhash for r in similarity.simhash(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t").collect()}
    for i, tokens in enumerate([[], [], ["one", "two", "two", "three"], ["数据分析", "a"], ["x"] * 70_000 + ["y"]]):
        hashes = [int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big") for t in tokens]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[i] == (bits - (1 << 64) if bits >> 63 else bits)


def test_life_cycles_of_a_shuffled_stream(spark, tmp_path):
    rng = random.Random(7)
    seen = [(f"p{p}", f"2024-{m:02d}-01 00:00:00", float(rng.choice([0, 1, 4, 4, 5, 9])), rng.choice([0.5, 0.7, 0.85]), rng.choice([1, 2, 3])) for p in range(6) for m in range(1, 13)]
    seen += [("p0", "2024-03-01 00:00:00", 99.0, 0.9, 3), ("p0", "2024-03-01 00:00:00", 1.0, 0.1, 1)]  # several for one period
    schema = "position_name string, ts string, freq double, confidence double, sources long"
    typed = lambda rows: spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    for quarter in range(4):
        some = [r for r in seen if (int(r[1][5:7]) - 1) // 3 == quarter]
        rng.shuffle(some)
        typed(some).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    late = [("p1", "2024-01-15 00:00:00", 50.0, 0.9, 3)]  # after the watermark has passed it
    typed([*late, ("end", "2100-01-01 00:00:00", 0.0, 0.0, 0)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    typed([("p1", "2024-01-20 00:00:00", 50.0, 0.9, 3), ("end", "2100-01-02 00:00:00", 0.0, 0.0, 0)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, lifecycle.ROCKSDB)
    try:
        stream = spark.readStream.schema(typed(seen[:1]).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = lifecycle.life_cycles(stream, "100 days").writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start()
        query.awaitTermination()
    finally:
        spark.conf.unset(key)
    got = sorted((r.position_name, str(r.ts), r.state) for r in spark.read.parquet(f"{tmp_path}/out").where("position_name <> 'end'").collect())
    want = sorted((r.position_name, str(r.ts), r.state) for r in lifecycle.replayed(typed(seen)).collect())
    assert got == want
    by = {}
    for p, ts, *o in sorted(seen):
        by.setdefault(p, {})[ts] = max(by.get(p, {}).get(ts, (0.0, 0.0, 0)), tuple(o))
    plain = []
    for p, periods in by.items():
        held = ("candidate", 0, 0.0, [])
        for ts, o in sorted(periods.items()):
            held = lifecycle.advanced(held, *o)
            plain.append((p, ts, held[0]))
    assert want == sorted(plain)
    assert {"candidate", "emerging", "declining", "stable"} >= {s for _, _, s in plain} > {"candidate"}
    assert lifecycle.replayed(typed(seen).limit(0)).collect() == []


def test_reading_order(spark):
    two = [("d", 1, 600.0, 40.0, 200.0, 10.0, "Left"), ("d", 1, 600.0, 40.0, 250.0, 30.0, "down"), ("d", 1, 600.0, 330.0, 500.0, 11.0, "Right"), ("d", 1, 600.0, 210.0, 260.0, 11.5, "side")]
    one = [("d", 2, 600.0, 40.0, 560.0, 5.0, "Whole"), ("d", 2, 600.0, 330.0, 500.0, 20.0, "end")]
    half = [("e", 1, 600.0, 40.0, 200.0, 10.0, "only"), ("e", 1, 600.0, 40.0, 200.0, 40.0, "left")]
    odd = [("e", 1, 600.0, None, 3.0, 1.0, "x"), ("e", 1, 600.0, 1.0, 3.0, 1.0, " "), (None, 1, 600.0, 1.0, 3.0, 1.0, "y"), ("f", 1, 0.0, 1.0, 3.0, 1.0, "zero"), ("f", 1, 0.0, 1.0, 3.0, 1.0, "zero")]
    df = spark.createDataFrame([*two, *one, *half, *odd], "doc string, page int, width double, x0 double, x1 double, top double, text string")
    got = {r.doc: (r.two_column, r.text) for r in layout.reflowed(df).collect()}
    assert got == {"d": (True, "Left side\ndown\nRight\nWhole\nend"), "e": (False, "only\nleft"), "f": (False, "zero zero")}
    assert [(r.doc, r.page, r.gutter) for r in layout.gutters(df).collect()] == [("d", 1, 295.0)]
    assert layout.reflowed(df.limit(0)).collect() == []
