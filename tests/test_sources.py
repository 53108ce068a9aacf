"""Readers, sinks and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from skillweft.sources import readers
from skillweft.streaming import incremental


def test_golden_set(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"id": "a", "gold": 1}\n\nnonsense\n{"id": "b"}\n')
    assert sorted(map(tuple, readers.golden_set(spark, str(tmp_path), "id string, gold int").collect())) == [("a", 1), ("b", None)]


def test_occupations(spark, tmp_path):
    (tmp_path / "o.csv").write_text("code,name,definition,aliases\n2001,Engineer,builds,a; b;;a\n,skipped,,\n#c,x,y,z\n9901,Other,,\n")
    rows = {r.code: r for r in readers.occupations(spark, str(tmp_path / "o.csv")).collect()}
    assert (rows["2001"].category, rows["2001"].aliases) == ("professional", ["a", "b"])
    assert (rows["9901"].category, rows["9901"].aliases) == ("other", [])
    with pytest.raises(ValueError, match="fewer than 5"):
        readers.occupations(spark, str(tmp_path / "o.csv"), 5)
    (tmp_path / "t.csv").write_text("code,title,source\n1,B,09\n1,A,10\n1,B,10\n1,C,01\n")
    assert [(r.code, r.aliases) for r in readers.job_titles(spark, str(tmp_path / "t.csv")).collect()] == [("1", ["B", "A"])]


def test_reports_replace_a_day(spark, tmp_path):
    for n in (1, 2):
        readers.write_report(spark.range(n), str(tmp_path), "2024-01-01")
    assert sorted(json.loads(x)["id"] for p in (tmp_path / "day=2024-01-01").glob("*.json") for x in p.read_text().split()) == [0, 1]
    assert readers.records(spark, str(tmp_path), "json").count() == 2


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    schema = "skill string, source string, ts timestamp"
    at = lambda d: dt.datetime(2024, 1, d, 12)
    for k, rows in enumerate(([("a", "s", at(1)), ("a", "s", at(7))], [("a", "s", at(8)), ("a", "s", at(30))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        assert k < 2
    stream = spark.readStream.schema(schema).parquet(str(source))
    q = incremental.weekly_counts(stream).writeStream.format("memory").queryName("weekly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.week_start.date(), r.cnt) for r in spark.table("weekly").collect()}
    assert got == {(dt.date(2024, 1, 1), 2), (dt.date(2024, 1, 8), 1), (dt.date(2024, 1, 29), 1)}
    q = incremental.upsert_sink(stream, str(tmp_path / "out"), ["skill"], str(tmp_path / "check"))
    q.awaitTermination()
    last = max(int(f.name) for f in (tmp_path / "out" / "_versions").iterdir())
    assert [r.ts for r in incremental.upserted(spark, str(tmp_path / "out"), stream.schema.simpleString()[7:-1].replace(":", " "), last).select("ts").collect()] == [at(30)]
    q = incremental.first_seen(stream, ["skill"], "60 days").writeStream.format("memory").queryName("first").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("first").agg(F.count("*")).first()[0] == 1
