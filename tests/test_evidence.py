"""Evidence functions, posting extraction and record keeping on small tables."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from jobweave.functions import evidence as V
from jobweave.operators import insight as I
from jobweave.operators import records as R


def one(spark, *columns):
    row = tuple(spark.range(1).select(*columns).first())
    return row[0] if len(row) == 1 else row


def test_texts(spark):
    L = F.lit
    assert one(spark, V.evidence_form(L("Ｓｐａｒｋ（SQL）、 a-b")), V.match_form(L(" A_b-c·d/e ")), V.match_form(L(None).cast("string"))) == ("sparksqlab", "abcde", "")
    assert one(spark, V.clipped(L("ab ，cd"), 4), V.clipped(L("a\n b"), 9), V.abbreviated(L("a  bcd"), 3)) == ("ab…", "a b", "a b")
    assert one(spark, V.grounded(L("负责数据平台建设"), L("你将 负责 数据/平台建设 工作")), V.grounded(L("短"), L("短")), V.grounded(L("spark flink hive x1"), L("we use Flink, Hive and spark"))) == (True, False, True)
    pairs = spark.createDataFrame([("x" * 30 + "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz???"), ("abc", "abc"), (None, "abcdefgh"), ("Ａbc-defgh", "ABC defgh")], "t string, e string")
    formed = pairs.select(V.evidence_form(F.col("t")).alias("t"), V.evidence_form(F.col("e")).alias("e"))
    assert [r[0] for r in formed.select(V.anchored(F.col("t"), F.col("e"))).collect()] == [True, False, False, True]
    assert one(spark, V.question_terms(L("请问 Spark 和 RAG 的数据治理工程师需要哪些 hive 技能")))[0:2] == ["spark", "hive"]
    assert one(spark, V.listed(L('["Java", "Go"；Java] name: C'), 2)) == ["Java", "Go"]
    text = "h" * 500 + "t" * 500
    assert one(spark, V.head_and_tail(L(text), 100)) == "h" * 72 + V.OMITTED + "t" * 28 and one(spark, V.head_and_tail(L(" x "), 100)) == "x"
    assert one(spark, V.percent(L(0.125)), V.points(L(-0.24)), V.points(L(3.0))) == ("12.5%", "-0.2pp", "+3.0pp")
    assert one(spark, V.fenced_json(L('so: ```{"a": {"b": 1}}``` ok')), V.fenced_json(L("none"))) == ('{"a": {"b": 1}}', None)
    assert one(spark, V.json_items(L('["a", "b"]')), V.json_items(L("a|b"))) == (["a", "b"], [])


def test_keys_and_scores(spark):
    L = F.lit
    want = "role-" + str(uuid.UUID(bytes=__import__("hashlib").md5(b"role\x00\xe7\x94\xb2").digest(), version=3))
    assert one(spark, V.stable_id("role", L("甲"))) == want
    assert one(spark, V.freshness(L("2026-06-30").cast("date"), L("2026-06-30").cast("date")), V.freshness(L("2020-01-01").cast("date"), L("2026-06-30").cast("date"))) == (1.0, 0.25)
    assert one(spark, V.clamped_run(F.array(L(10.0), L(40.0), L(-100.0)))) == [66.0, 88.0, 12.0]
    assert one(spark, V.answer_confidence(L(0), L(True), L(0)), V.answer_confidence(L(4), L(True), L(0)), V.answer_confidence(L(1), L(False), L(2))) == (0.25, 0.94, 0.58)
    assert one(spark, V.opportunity(L(1.0), L(1.0), L(1.0), L(0.0)), V.risk_level(L(0.2))) == (99, "REVIEW")


JD = "岗位职责：负责数据平台的设计与开发；熟悉 Spark 优先。参与实时数仓建设与维护工作\n要求掌握 Java 编程能力和框架；短"


def test_extraction(spark):
    posts = spark.createDataFrame([(1, "【急招】高级大数据工程师（双休）", JD), (2, None, None)], "id int, title string, text string")
    found = spark.createDataFrame([(1, "Spark"), (1, "Java"), (1, "沟通能力"), (1, "Java")], "id int, skill string")
    rows = {r["id"]: r for r in I.extract_postings(posts, found, "id", "title", "text").collect()}
    a, b = rows[1], rows[2]
    assert (a["stack"], a["level"], a["required"], a["bonus"], a["scenarios"]) == ("后端开发", "高级", ["Java", "Spark"], [], ["实时数据仓库"])
    assert a["duties"] == ["岗位职责：负责数据平台的设计与开发", "参与实时数仓建设与维护工作"] and a["confidence"] == pytest.approx(0.848)
    assert (b["role"], b["duties"], b["scenarios"], b["required"], b["confidence"]) == ("未命名岗位", ["完成未命名岗位相关系统设计、开发、优化与交付"], ["人工智能业务场景"], [], 0.72)
    far = spark.createDataFrame([(3, "x", "掌握 Java" + "一" * 80 + "Spark 优先")], "id int, title string, text string")
    got = I.skill_buckets(far, spark.createDataFrame([(3, "Java"), (3, "Spark")], "id int, skill string"), "id", "text").collect()
    assert {(r["skill"], r["part"]) for r in got} == {("Java", "REQUIRED"), ("Spark", "BONUS")}
    assert I.gate(found, spark.createDataFrame([(1, "Java")], "id int, skill string"), ["id", "skill"]).first()[1:] == (1, 2)


def test_canonical_names(spark):
    names = spark.createDataFrame([("Spring Boot", "spring-boot", 1), ("Spring", "Spring", 2), ("Go", "go", 3), ("空", None, 4)], "name string, alias string, rank int")
    values = spark.createDataFrame([("SPRING_BOOT",), ("springboot3",), ("Spr ing",), ("pri",), ("goo",), (" x ",), ("",), (None,)], "v string")
    got = {r["v"]: (r["canonical"], r["how"]) for r in I.canonical_names(values, "v", names).collect()}
    assert got == {"SPRING_BOOT": ("Spring Boot", "equal"), "springboot3": ("Spring Boot", "part"), "Spr ing": ("Spring", "equal"), "pri": ("Spring Boot", "part"), "goo": ("goo", "own"), " x ": ("x", "own")}
    ok = {r[0]: r[1] for r in spark.createDataFrame([("C",), ("a",), ("Java",), ("沟通能力",), ("操作 系统",), ("x" * 26,), (" ",), ("后端经验",)], "s string").select("s", I.plausible_skill(F.col("s"))).collect()}
    assert [k for k, v in ok.items() if v] == ["C", "Java"]


def test_records(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, None)], "k int, v string")
    assert {tuple(r) for r in R.upsert(old, new, ["k"], ["v"]).collect()} == {(1, "a"), (2, "d"), (3, None)}
    state = spark.createDataFrame([("x", 2, 5, 9)], "k string, n int, lo int, hi int")
    batch = spark.createDataFrame([("x", 1, 3, 4), ("y", 7, 1, 1)], "k string, n int, lo int, hi int")
    assert {tuple(r) for r in R.added(state, batch, ["k"], ["n"], ["lo"], ["hi"]).collect()} == {("x", 3, 3, 9), ("y", 7, 1, 1)}
    rows = spark.createDataFrame([(1, "AUTO"), (2, "REVIEWED"), (3, None)], "id int, status string")
    fresh = spark.createDataFrame([(9, "AUTO")], "id int, status string")
    assert {tuple(r) for r in R.replaced(rows, fresh, "status", "AUTO").collect()} == {(2, "REVIEWED"), (3, None), (9, "AUTO")}
    base = spark.createDataFrame([(1, "a", "REVIEWING"), (2, "b", "REVIEWING"), (3, "c", "REVIEWING")], "id int, v string, status string")
    decisions = spark.createDataFrame([(1, "REJECT", "x", 1), (1, "APPROVE", None, 2), (2, "REJECT", "z", 1)], "id int, decision string, v string, t int")
    assert {tuple(r) for r in R.reviewed(base, decisions, "id", ["v"], "status", ["t"]).collect()} == {(1, "a", "PUBLISHED", 0), (2, "z", "REJECTED", 1), (3, "c", "REVIEWING", 0)}
    had = spark.createDataFrame([(1, "a"), (1, "b")], "k int, s string")
    edits = spark.createDataFrame([(1, "a", "DELETE", 1), (1, "c", "ADD", 1), (1, "b", "DELETE", 1), (1, "b", "ADD", 2), (2, "d", "DELETE", 1)], "k int, s string, action string, t int")
    assert {tuple(r) for r in R.edited_skills(had, edits, ["k", "s"], ["t"]).collect()} == {(1, "b", "LOADED"), (1, "c", "MANUAL")}
    assert R.upsert(old.limit(0), new.limit(0), ["k"], ["v"]).count() == 0
