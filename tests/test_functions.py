"""Column functions at their boundary values."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from skillweft.functions import positions
from skillweft.functions import scores as S
from skillweft.functions import text as X


def values(spark, column, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def one(spark, column, schema, *row):
    return values(spark, column, schema, [row])[0]


def test_employment(spark):
    got = values(spark, X.employment_reason(F.col("t"), F.col("g")), "t string, g array<string>", [("Summer Internships", None), ("Internal auditor", []), ("Part-time cook", None), ("兼职", None), ("数据实习生", None), ("Cook", ["PART_TIME"]), ("Cook", ["大学生实习"]), ("Cook", ["INTERN", "parttime"]), (None, None)])
    assert got == ["intern", None, "part-time", "part-time", "intern", "part-time", None, "intern", None]


def test_invalid_jobs(spark):
    got = values(spark, X.invalid_job_reason(F.col("t")), "t string", [("Java/C++/Python",), ("Java工程师/C++/Python",), ("急招",), ("Java/C",), ("",), (None,)])
    assert got == ["aggregated", None, "aggregated", None, None, None]


@pytest.mark.parametrize(
    ("raw", "source", "want"),
    [("1.5-3万·14薪", None, 22500.0), ("50-80K", None, 65000.0), ("200-220元/天", None, 4410.0), ("$171,000.00 - $260,000.00 / year", None, 125708.33), ("USD 175000.0-250000.0/年", None, 123958.33), ("up to $120/hour", None, 141120.0), ("up to 170k", None, 170000.0), ("up to 170k", "indeed", 99166.67), ("up to $170k", None, 99166.67), ("negotiable", None, None), ("", None, None), (None, None, None)],
)
def test_salary(spark, raw, source, want):
    got = one(spark, X.monthly_salary(F.col("r"), F.col("s")), "r string, s string", raw, source)
    assert got == want if want is None else math.isclose(got, want, abs_tol=0.011)


def test_parsed_values(spark):
    assert values(spark, X.duration_hours(F.col("d")), "d string", [("约 4 周左右",), ("2 个月",), ("10 hours",), ("3 days",), ("1.5h",), ("soon",), (None,)]) == [160.0, 320.0, 10.0, 24.0, 1.5, None, None]
    assert [tuple(x) for x in values(spark, X.experience_range(F.col("d")), "d string", [("3-5年",), ("10年以上",), ("不限",), ("?",)])] == [(3, 5), (10, None), (0, None), (None, None)]
    assert values(spark, X.min_years(F.col("d")), "d string", [("5年以上",), ("none",), (None,)]) == [5, None, None]
    assert values(spark, X.proficiency(F.col("d")), "d string", [("精通 Python",), ("熟练掌握",), ("了解",), ("高级",), ("?",)]) == ["高级", "中级", "初级", "高级", None]
    assert values(spark, X.education_score(F.col("a"), F.col("b")), "a string, b string", [("本科及以上", "硕士"), ("硕士", "本科"), ("博士", "大专"), (None, "本科")]) == [1.0, 0.5, 0.0, None]
    assert values(spark, X.week_key(F.col("d")), "d date", [(dt.date(2027, 1, 1),), (dt.date(2024, 1, 1),)]) == ["2026-W53", "2024-W01"]
    assert values(spark, X.week_key_of_text(F.col("d")), "d string", [("2024-01-01T10:00:00",), ("not a date at all",)]) == ["2024-W01", "not a date"]
    assert values(spark, X.loose_date(F.col("d")), "d string", [("2024-02-03T10:00:00Z",), ("2024/02/03",), ("20240203",), ("2024.02.03",), ("x",), (None,)]) == [dt.date(2024, 2, 3)] * 4 + [None, None]
    assert values(spark, X.instant(F.col("d")).isNull(), "d string", [("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00+08:00",), ("garbage",), (None,)]) == [False, False, True, True]
    assert values(spark, X.token_estimate(F.col("d")), "d string", [("中文ab",), ("abcde",), ("",)]) == [3, 2, 0]
    assert values(spark, X.split_skills(F.col("d")), "d string", [("a, b,,c ",)]) == [["a", "b", "c"]]
    assert one(spark, X.fulltext_query(F.col("d")), "d string", 'a+b:"c"') == "a b  c"


def test_masks(spark):
    text, originals = X.masked(F.col("t"), "王李")
    df = spark.createDataFrame([("13800138000 and 13900139000, a@b.cn 王小明 in 11010519491231002X",), ("none",), (None,)], "t string").select("t", text.alias("m"), originals.alias("o"))
    rows = df.withColumn("back", X.restored(F.col("m"), F.col("o"))).collect()
    assert rows[0].m == "[PHONE] and [PHONE_2], [EMAIL] [NAME] in [ID_CARD]"
    assert rows[0].o["[PHONE_2]"] == "13900139000"
    assert [r.back for r in rows] == [r.t for r in rows]
    assert values(spark, X.desensitised(F.col("t")), "t string", [("x138001380001",), ("tel 13800138000.",), ("110105194912310021",)]) == ["x138001380001", "tel [PHONE].", "[ID_CARD]"]


def test_skills(spark):
    assert values(spark, X.skill_alias(F.col("s")), "s string", [(" golang ",), ("JS",), ("PYTHON",), ("Foo",), (None,), ("vue",), ("llm",), ("GO",)]) == ["Go", "JavaScript", "Python", "Foo", None, "Vue.js", "大语言模型", "Go"]
    assert values(spark, X.clean_skill(F.col("s")), "s string", [("前端开发",), ("项目管理",), ("软件工程师",)]) == ["前端", "项目管理", "软件"]
    assert values(spark, X.canonical_skill(F.col("s")), "s string", [("K8S",), ("Spark框架",), ("spark",)]) == ["kubernetes", "spark", "apache spark"]
    assert values(spark, X.valid_skill(F.col("s")), "s string", [("C",), ("x",), ("金融",), ("Go",)]) == [True, False, False, True]
    assert values(spark, X.noise(F.col("s")), "s string", [("123",), ("１２",), ("x" * 31,), ("Rust",)]) == [True, True, False, False]
    assert values(spark, X.shared_bigrams(F.lit("数据分析师"), F.lit("数据分析员")), "s int", [(1,)]) == [3]
    assert values(spark, X.contains_name(F.lit("abcd"), F.lit("abc")), "s int", [(1,)]) == [False]


NAMES = [
    ("Senior Software Engineer", "软件开发工程师"),
    ("Data Analyst, Growth", "数据分析师"),
    ("Lead Data Scientist (Remote)", "数据分析师"),
    ("Sr. SRE / Platform", "运维工程师"),
    ("web前端开发工程师", "前端开发工程师"),
    ("React前端开发工程师", "React前端开发工程师"),
    ("前端开发工程师(React)", "React前端开发工程师"),
    ("前端开发工程师（上海）", "前端开发工程师"),
    ("高级量化分析师", "量化分析师"),
    ("分析师", "分析师"),
    ("信贷分析师主管", "信贷分析师"),
    ("技术", ""),
    ("数据实习生", ""),
    ("", ""),
    (None, ""),
    ("大数据开发", "大数据开发工程师"),
    ("厨师", "厨师"),
    ("财务经理", "财务"),
    ("项目经理助理", "项目经理助理"),
    ("开发工程师", ""),
    ("工程师", ""),
    ("C++ 开发", "C++开发工程师"),
]


def test_position_names(spark):
    assert values(spark, positions.normalized(F.col("s")), "s string", [(n,) for n, _ in NAMES]) == [w for _, w in NAMES]


def test_position_names_join_back(spark):
    rows = spark.createDataFrame([(1, "web前端"), (2, None), (3, "web前端")], "id int, title string")
    assert sorted((r.id, r.standard) for r in positions.normalize_positions(rows, "title", "standard").collect()) == [(1, "前端开发工程师"), (2, ""), (3, "前端开发工程师")]


def test_scores(spark):
    assert values(spark, S.jaccard(F.col("a"), F.col("b")), "a array<int>, b array<int>", [([1, 2], [2, 3]), ([], []), ([1], [1, 1])]) == [1 / 3, 0.0, 1.0]
    assert values(spark, S.cosine(F.col("a"), F.col("b")), "a array<float>, b array<float>", [([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])]) == [1.0, 0.0]
    assert values(spark, S.wilson(F.col("a"), F.col("b")), "a long, b long", [(0, 0), (0, 10), (10, 10)])[:2] == [0.0, 0.0]
    assert values(spark, S.trend(F.col("z"), F.col("n")), "z double, n long", [(2.1, 10), (2.0, 10), (-1.6, 10), (1.5, 10), (9.0, 9)]) == ["emerging", "rising", "declining", "stable", "protected"]
    assert values(spark, S.passes_gate(F.col("z"), F.col("s"), F.col("m"), F.col("h"), F.lit(3), F.lit(3)), "z double, s long, m double, h int", [(2.5, 2, 9.0, 60), (1.8, 2, 1.0, 60), (2.5, 2, 10.0, 60), (None, 9, 99.0, 99), (9.0, 3, 0.0, 59), (9.0, 2, 0.0, 59)]) == [False, True, True, False, True, False]
    assert values(spark, S.inflation(F.col("l"), F.lit(3), F.lit(5), F.lit(0), F.lit(2)).score, "l string", [("初级",)]) == [0.0]
    assert [round(v, 6) for v in values(spark, S.inflation(F.lit("初级"), F.col("y"), F.lit(0), F.lit(0), F.lit(0)).score, "y int", [(8,), (13,)])] == [0.689, 0.689]
    assert values(spark, S.staleness_penalty(F.col("d"), F.to_date(F.lit("2024-12-31"))), "d date", [(dt.date(2023, 1, 1),), (dt.date(2024, 6, 1),), (dt.date(2024, 12, 1),), (None,)]) == [0.85, 0.95, 1.0, 1.0]
    assert values(spark, X.decay_weight(F.col("d"), F.to_date(F.lit("2024-02-01"))), "d date", [(dt.date(2024, 1, 2),), (None,), (dt.date(2024, 1, 1),)]) == [1.0, 1.0, math.exp(-0.01)]
    q = S.course_quality(F.col("p"), F.col("r"), F.col("e"), F.col("d"), F.lit(None).cast("double"), F.lit(0), F.to_date(F.lit("2024-01-01")))
    rows = values(spark, q, "p string, r double, e long, d date", [("Coursera", 0.0, 100_000, None), ("?", 5.0, 0, dt.date(2010, 1, 1))])
    assert [(r.platform, r.rating, r.enrollment, r.recency) for r in rows] == [(1.0, 0.5, 1.0, 0.5), (0.5, 1.0, 0.0, 0.5)]


def test_quality(spark):
    q = X.quality({"title": F.col("t"), "description": F.col("d")})
    rows = values(spark, q, "t string, d string", [("x", "a" * 20), (None, None), ("design", "build and manage " * 20)])
    assert rows[0].format_score == 0.5
    assert (rows[1].completeness, rows[1].length_score, rows[1].keyword_score, rows[1].format_score) == (0.0, 0.0, 0.0, 1.0)
    assert (rows[2].length_score, rows[2].keyword_score) == (1.0, 1.0)
