"""Formulas against worked examples, text functions against exact strings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from jobweave.functions import text as T
from jobweave.functions.measures import saturation
from jobweave.functions.titles import clean_title, plausible_title
from jobweave.operators import documents as D
from jobweave.operators import forecast as P
from jobweave.operators import governance as G
from jobweave.operators import matching as M
from jobweave.operators.evolution import changes, java_hash, market_weight
from jobweave.plans.questions import intent_of, plans_for


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lits(*values):
    return [F.lit(v) for v in values]


def test_scores(spark):
    assert one(spark, P.novelty(*lits(0.9, 0.8, 0.8, 4, 12)))[0] == pytest.approx(0.87)
    got = one(spark, P.trust_confidence(*lits(10, 5, 0.9, 0.1, 0.9)), P.trust_confidence(*lits(1, 1, 0.5, 0.8, 0.4)))
    assert got == pytest.approx((0.95, 0.29375))
    assert one(spark, P.trust_risk(*lits(1, 1, 0.4, True)), P.trust_risk(*lits(10, 5, 0.9, False))) == pytest.approx((0.93, 0.055))
    assert one(spark, *[G.duplicate_weight(F.lit(n)) for n in (1, 2, 3, 4, 44, 45, 100)]) == (1, 0.707107, 0.57735, 0.5, 0.150756, 0.15, 0.15)
    assert one(spark, saturation(F.lit(10), 60))[0] == pytest.approx(0.58566, abs=1e-5)


def test_candidates(spark):
    rows = [(2000, "t1", 10, 3, 7, 5), (1999, "t2", 38, 0, 0, 9), (2000, "t2", 40, 20, 20, 20), (1999, "t3", 1, 0, 0, 1), (2000, "t3", 3, 0, 3, 2), (1999, "t4", 9, 0, 0, 9), (2000, "t4", 12, 3, 9, 8), (1998, "t1", 99, 9, 9, 9)]
    years = spark.createDataFrame(rows, "year int, title string, n long, h1 long, h2 long, companies long")
    got = {r["title"]: (r["novelty"], r["momentum"], r["score"], r["confidence"]) for r in P.candidates(years).where("year = 2000").collect()}
    assert set(got) == {"t1", "t3", "t4"}
    assert got["t1"] == pytest.approx((1, 0.7, 0.743132, 0.600551), abs=1e-5)
    assert got["t3"] == pytest.approx((0.666667, 1, 0.694384, 0.41533), abs=1e-5)
    assert got["t4"] == pytest.approx((0.25, 0.75, 0.540292, 0.654722), abs=1e-5)


def test_discovery(spark):
    rows = [(2000, "a", 20, 5, 15, 8, 3, 0.8), (2000, "b", 6, 0, 6, 2, 2, 0.6), (2000, "c", 50, 25, 25, 20, 5, 0.9), (2000, "d", 5, 0, 5, 3, 3, 0.9)]
    years = spark.createDataFrame(rows, "year int, title string, n long, h1 long, h2 long, companies long, sources long, quality double").withColumn("shown", F.col("title"))
    got = {r["title"]: (r["novelty"], r["confidence"]) for r in P.discovered(years).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"] == pytest.approx((0.75352, 0.8495), abs=1e-4)
    assert got["b"] == pytest.approx((0.741731, 0.652833), abs=1e-4)


def match(spark, profile, needs, level, **limits):
    columns = "id int, skills array<string>, projects string, internships array<string>, years double, education string"
    df = spark.createDataFrame([(1, *profile)], columns)
    wanted = spark.createDataFrame([("r", *n) for n in needs], "role string, skill_name string, kind string, importance double")
    return M.match_profiles(df, wanted, spark.createDataFrame([("r", level)], "role string, level string"), **limits)


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0}])
def test_match_score(spark, limits):
    parts = ["overall", "skill", "internship", "project", "stack", "level", "education"]
    need = [("Java", "REQUIRED", 1.0), ("Spring Boot", "REQUIRED", 0.8)]
    got = match(spark, (["Java", "Spring Boot"], "Java项目", ["JAVA实习", "行政实习"], 2.0, "本科"), need, "中级", **limits).first()
    assert [got[p] for p in parts] == pytest.approx((77.7, 100, 65, 45, 51, 86.7, 88), abs=0.11) and got["missing"] == []
    got = match(spark, (["Java"], None, [], 1.0, "硕士"), [*need, ("Docker", "BONUS", 1.0)], "高级", **limits).first()
    assert [got[p] for p in parts] == pytest.approx((50.5, 55.6, 30, 35, 48, 68, 95), abs=0.11) and got["missing"] == ["Spring Boot"]
    none = match(spark, ([], "x", None, None, None), need, None, **limits)
    assert none.count() == 0
    odd = match(spark, (["Java", "Java", ""], "x", None, None, None), need, None, **limits).first()
    assert (odd["level"], odd["education"], odd["internship"], odd["stack"]) == (60.0, 60.0, 30.0, 48.0)


def test_prerequisites(spark):
    df = spark.createDataFrame([(1, ["Spring", "Java", "Vue"]), (2, []), (3, None)], "id int, s array<string>")
    direct = spark.createDataFrame([("Spring", 1, "Java"), ("Vue", 2, "HTML"), ("Vue", 1, "JS"), ("x", 1, "y")], "skill string, place int, prerequisite string")
    got = {r["id"]: r["skills"] for r in M.with_prerequisites(df, "id", "s", direct).collect()}
    assert got == {1: ["Java", "Spring", "JS", "HTML", "Vue"], 2: list(M.GENERAL_STAGES), 3: list(M.GENERAL_STAGES)}
    rows = M.learning_plan(spark.createDataFrame([(1, ["a", "b", "c"])], "id int, s array<string>"), "id", F.col("s"), F.lit(12), F.lit(5)).orderBy("stage").collect()
    assert [(r["tier"][:3], r["priority"]) for r in rows] == [("第一层", "P0"), ("第二层", "P0"), ("冲刺层", "P1"), ("顶层：", "P2")]


@pytest.mark.parametrize("n, weeks, want", [(3, 12, "1-3 4-6 7-9 10-12"), (9, 12, "1-2 3-4 5-6 7-8 9-10 11-12"), (8, 16, "1-2 3-4 5-6 7-8 9-10 11-13 14-16"), (2, 1, "1-1"), (5, 3, "1-1 2-2 3-3")])
def test_learning_plan(spark, n, weeks, want):
    df = spark.createDataFrame([(1, [f"s{k}" for k in range(n)])], "id int, s array<string>")
    rows = M.learning_plan(df, "id", F.col("s"), F.lit(weeks), F.lit(5)).orderBy("stage").collect()
    assert " ".join(f"{r['first_week']}-{r['last_week']}" for r in rows) == want


def test_evolution(spark):
    assert one(spark, *[java_hash(F.lit(s)) for s in ("scala", "hadoop", "etl")]) == (109250886, -1224864731, 100765)
    assert one(spark, *[F.round(market_weight(F.lit(s)), 4) for s in ("scala", "hadoop", "etl", "RAG 应用", "MySQL")]) == (0.985, 0.95, 0.915, 1.34, 1.04)
    rows = [
        (2001, "r", "rag added", 5, 4.0, 2.0, 0.0, 0.10), (2000, "r", "mysql weak", 8, 6.0, 3.0, 0.0, 0.20), (2001, "r", "mysql weak", 8, 6.0, 3.0, 0.0, 0.05),
        (2000, "r", "x changed", 6, 5.0, 1.0, 2.0, 0.20), (2001, "r", "x changed", 6, 5.0, 5.0, 0.0, 0.25), (2001, "r", "too few", 2, 4.0, 2.0, 0.0, 0.5),
    ]
    rates = spark.createDataFrame(rows, "published_year int, title_standard string, skill_name string, evidence long, support double, required double, bonus double, rate double")
    got = {r["skill_name"]: (r["change"], r["forecast_delta"]) for r in changes(rates, (2000, 2001)).collect()}
    assert got == {"rag added": ("ADDED", 19.3), "mysql weak": ("WEAKENED", -30.9), "x changed": ("MODIFIED", 8.9)}


def test_title_similarity(spark):
    pairs = [("data engine", "data engine", 1), ("data engine", "dataengine", 0.98), ("java", "java backend", 0.832727), ("data lake", "data mesh", 0.272727), ("abc", "xyz", 0), ("", "a", 0)]
    got = one(spark, *[F.round(T.title_similarity(F.lit(a), F.lit(b)), 6) for a, b, _ in pairs])
    assert got == tuple(p[2] for p in pairs)


def test_texts(spark):
    n = lambda s: T.normalise(F.lit(s))
    assert one(spark, n(" Java   Spring Boot "), n("Ａ  b")) == ("java spring boot", "a b")
    assert one(spark, F.sha2(n("A B"), 256) == F.sha2(n("a  b"), 256))[0]
    j = T.jaccard(T.tokens(F.lit("Java Spring MySQL Redis")), T.tokens(F.lit("Java Spring MySQL Docker")))
    assert one(spark, j)[0] == pytest.approx(0.6)
    assert one(spark, clean_title(F.lit("风电运维工程师 入职六险一金 无实习")), clean_title(F.lit("数据库架构师 -基础设施"))) == ("风电运维工程师", "数据库架构师（基础设施方向）")
    p = lambda s: plausible_title(clean_title(F.lit(s)))
    assert one(spark, p("居家客服、电销、审核、标注员"), p("标注员"), p("风电运维工程师"), p("智能体应用工程师")) == (False, False, True, True)
    c = lambda s: D.clean_sentence(F.lit(s))
    assert one(spark, c("、3、 3、岗位职责：负责数据库新技术研究并结合业务项目落地"), c("5.岗位职责： 负责风力发电机组的日常巡检、维护、故障消缺和检修")) == ("负责数据库新技术研究并结合业务项目落地", "负责风力发电机组的日常巡检、维护、故障消缺和检修")
    r = lambda s: D.is_responsibility(c(s))
    assert one(spark, r("负责数据库物理部署方案和应用架构设计方案落地"), r("3)需持有高压电工证、低压电工证和高处维护作业证"), r("具备全局视角，能够发现问题并推动业务项目")) == (True, False, False)
    assert one(spark, D.private_host(F.lit("http://127.0.0.1/internal")), D.private_host(F.lit("https://a.example/p")), D.private_host(F.lit("no address"))) == (True, False, True)
    assert one(spark, D.html_to_text(F.lit("<p>a&nbsp;&lt;b</p><script>x</script>c")))[0] == "a <b\nc"


def test_questions():
    plan = plans_for("请根据数据库里面25级最多数量的岗位得出可能的预测")[0]
    assert (plan.kind, plan.year, plan.limit) == ("TOP_ROLES", 2025, 10)
    assert plans_for("2024年哪些城市，前500名")[0].limit == 10
    assert plans_for("hello")[0].kind == "MARKET_SUMMARY"
    assert (intent_of("给我学习路线"), intent_of("薪资")) == ("LEARNING", "DATA")
