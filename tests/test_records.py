"""Rules on nested records."""

from pyspark.sql import functions as F

from skillweft.operators import records


def values(spark, column, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_resume_rules(spark):
    r = records.resume_rules(F.col("t"))
    got = values(spark, r, "t string", [("2018年入职，5年经验，本科 Python k8s",), ("经验 3.5 年",), ("2018年-2022年",), ("做了4年",), ("",)])
    assert [x.total_years for x in got] == [5.0, 3.5, 0.0, 4.0, 0.0]
    assert got[0].education_level == "本科"
    assert {"Python", "Kubernetes"} <= set(got[0].skills)


def test_resume_skills(spark):
    skills = spark.createDataFrame([(1, 1, "python", 3), (1, 2, "Python", 1), (1, 3, "金融", 2), (1, 4, "Foo", 2), (1, 5, "沟通能力", 3)], "id int, seq int, name string, proficiency int")
    soft = spark.createDataFrame([(1, "沟通能力"), (1, "领导力"), (1, "bravery")], "id int, name string")
    got = {r.name: (r.proficiency, r.unmapped, r.low_confidence) for r in records.resume_skills(skills, soft, "id").collect()}
    assert got == {"Python": (3, False, False), "Foo": (2, True, False), "沟通能力": (3, False, False), "领导力": (2, False, True)}


def test_golden_rules(spark):
    assert values(spark, records.golden_title(F.col("t")), "t string", [("Python 算法工程师（CV 方向）",), ("Java/Python/C/测试岗",), ("a   b",), ("资深全栈开发工程师（Python/Vue）",)]) == ["Python 算法工程师", "软件开发工程师", "a b", "资深全栈开发工程师"]
    assert values(spark, records.golden_skills(F.col("t")), "t array<string>", [(["Django", "5天/周", "本科", "js", "JavaScript", "7", "django", "22"],)]) == [["Django", "js", "JavaScript"]]


def test_remaps_and_invalid_positions(spark):
    assert values(spark, records.remapped(F.col("n"), F.col("t")), "n string, t string", [("微", "懂微服务"), ("微", "x"), ("前端开发", "")]) == ["微服务", "微", "前端"]
    d = spark.createDataFrame([("系统",), ("算法工程师",), (None,)], "standard string")
    assert [r.standard for r in records.invalid_positions(d, "standard").collect()] == ["系统"]


def test_nested_nulls(spark):
    schema = "id int, e struct<requirements: array<struct<skill_name: string, necessity: string, level: string>>, skills: array<struct<name: string>>>"
    rows = [(1, (None, [("a",), (None,), ("",)])), (2, ([("b", None, None)], None)), (3, (None, None)), (4, None), (5, ([], [("c",)]))]
    assert values(spark, F.coalesce(records.skills_of(F.col("e")), F.array().cast("array<string>")), schema, rows) == [["a"], ["b"], [], [], ["c"]]
    got = sorted(map(tuple, records.position_skills(spark.createDataFrame(rows, schema), "e").collect()))
    assert got == [(1, "a", "nice", ""), (2, "b", "nice", ""), (5, "c", "nice", "")]


def test_hashed_embedding(spark):
    v = values(spark, records.hashed_embedding(F.col("t"), 16), "t string", [("abc def",), ("abc def",), ("",), (None,)])
    assert v[0] == v[1]
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-5
    assert v[2] == v[3] == [0.0] * 16
