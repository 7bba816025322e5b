from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from jobweave.llm.canonical import grams, match_values, normal_value
from jobweave.llm.components import components
from jobweave.llm.near_duplicates import expand_pairs, jaccard, meeting_pairs, similar_groups, similar_pairs
from jobweave.llm.record_queries import QUERIES
from jobweave.llm.skeleton import equal_looking, plain_form, skeleton, stand_ins, with_forms
from jobweave.llm.survivors import group_members, surviving_values, survivors

FIELDS = ("city", "pay")
JOB = "raw_job_id long, duplicate_group string, is_deleted int, source_name string, published_at date, quality_score double, city string, pay double, value string, field_name string"


def test_survivors(spark):
    from datetime import date

    d = date(2024, 1, 1)
    rows = [
        (1, "g", 0, " b ", d, 0.5, "x", None, "v", "f"), (2, "g", 0, "A", None, 0.1, "  ", 5.0, "v", "f"), (3, "g", 0, "a", d, 0.1, "y", None, "v", "f"), (4, "g", 0, "a", d, 0.1, "y2", None, "v", "f"), (5, "g", 1, "a", d, 9.0, "z", 9.0, "v", "f"),
        (6, "h", 0, None, None, None, "未知", None, "v", "f"), (7, "h", 0, "c", None, None, "N/A", None, "v", "f"), (8, "one", 0, "a", d, 1.0, "q", 1.0, "v", "f"), (9, None, 0, "a", d, 1.0, "q", 1.0, "v", "f"), (10, " ", 0, "a", d, 1.0, "q", 1.0, "v", "f"), (11, " ", 0, "a", d, 1.0, "q", 1.0, "v", "f"),
        (12, "i", 0, None, d, None, "学历不限", None, "v", "f"), (13, "i", 0, "zz", d, 0.0, "w" * 9000, None, "v", "f"), (13, "i", 0, "zz", d, 0.0, "w" * 9000, None, "v", "f"),
    ]
    jobs = spark.createDataFrame(rows, JOB)
    trust = spark.createDataFrame([("a", 1), ("B ", 2), ("b", 7), (None, 0)], "source_name string, trust_rank int")
    members = group_members(jobs, "duplicate_group", F.col("is_deleted") == 0)
    values = surviving_values(members, trust, FIELDS)
    got = {(r[0], r[1]): r[2] for r in values.collect()}
    assert got == {("g", "city"): 3, ("g", "pay"): 2, ("i", "city"): 13}
    assert {tuple(r) for r in surviving_values(members, trust, FIELDS, trust_limit=0).select("duplicate_group", "field_name", "raw_job_id").collect()} == {(*k, v) for k, v in got.items()}
    assert survivors(values, FIELDS).where("duplicate_group = 'g'").first()["pay"] == "5.0"
    assert surviving_values(members.limit(0), trust, FIELDS).count() == 0
    assert surviving_values(members, trust.limit(0), FIELDS).count() == 3


def base_texts(rng, n):
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(400)]
    return [" ".join(rng.choice(words) for _ in range(60)) for _ in range(n)]


def test_pairs_against_all_pairs(spark):
    rng = random.Random(3)
    texts = base_texts(rng, 60)
    rows = []
    for t in texts:
        rows.append(t)
        for share in (0.0, 0.02, 0.04, 0.08, 0.5):
            rows.append(" ".join("changed" + str(rng.random()) if rng.random() < share else w for w in t.split(" ")))
        rows.append(t.upper().replace(" ", " - "))
    table = [(k, t, "a", "b") for k, t in enumerate(rows)] + [(9000, None, "a", "b"), (9001, "", "a", "b"), (9002, "短" * 20, "a", "b"), (9003, "!" * 99, "a", "b"), (None, rows[0], "a", "b"), (9004, "汉字" * 9000, "a", "b"), (5, rows[5], "a", "b")]
    df = spark.createDataFrame(table, "id long, text string, block string, rep string")
    ids = list(range(len(rows)))
    pairs = list(itertools.combinations(ids, 2))
    exact = jaccard([rows[a].lower() for a, _ in pairs], [rows[b].lower() for _, b in pairs])
    reps, members = similar_pairs(df, "id", "text")
    got = {tuple(r) for r in expand_pairs(reps, members).distinct().collect()}
    sure = {p for p, s in zip(pairs, exact, strict=True) if s >= 0.66}
    allowed = {p for p, s in zip(pairs, exact, strict=True) if s >= 0.6}
    assert got <= allowed
    assert len(sure - got) <= 0.01 * len(sure)
    groups = {r["id"]: r for r in similar_groups(reps, members).collect()}
    assert set(groups) == {*ids, 9004}
    assert groups[0]["group_id"] == 0 and groups[1]["group_id"] == 0 and groups[0]["copies"] >= 3
    assert groups[9004]["group_id"] == 9004 and groups[9004]["links"] == 0
    empty = similar_pairs(df.limit(0), "id", "text")
    assert expand_pairs(*empty).count() == 0 and similar_groups(*empty).count() == 0


@pytest.mark.parametrize("limit", [200_000, 0])
def test_hot_blocks_are_dealt(spark, monkeypatch, limit):
    monkeypatch.setattr("jobweave.llm.near_duplicates.HOT_BLOCK", 128)
    monkeypatch.setattr("jobweave.llm.near_duplicates.BROADCAST_ROWS", limit)
    rows = [(k, 1) for k in range(600)] + [(k, 2) for k in range(590, 700)] + [(k, 3) for k in (1, 650)]
    got = [tuple(r) for r in meeting_pairs(spark.createDataFrame(rows, "id long, block long")).collect()]
    by_block = [[k for k, b in rows if b == x] for x in (1, 2, 3)]
    want = sorted((a, b) for ids in by_block for a in ids for b in ids if a < b)
    assert sorted(got) == want


def test_expanded_pairs_of_large_classes(spark, monkeypatch):
    monkeypatch.setattr("jobweave.llm.near_duplicates.COPIES_PER_TASK", 3)
    members = spark.createDataFrame([(k, 0) for k in range(10)] + [(k, 20) for k in range(20, 24)] + [(30, 30)], "id long, rep long")
    pairs = spark.createDataFrame([(0, 20), (20, 30)], "id_a long, id_b long")
    got = [tuple(r) for r in expand_pairs(pairs, members).collect()]
    same = lambda ids: {(a, b) for a in ids for b in ids if a < b}
    want = same(range(10)) | same(range(20, 24)) | {(a, b) for a in range(10) for b in range(20, 24)} | {(a, 30) for a in range(20, 24)}
    assert len(got) == len(want) and set(got) == want


def test_jaccard_on_plain_sets():
    a, b = "数据 平台, 工程师 ab1 数据平台", "数据平台工程师 AB1 数据".lower()

    def sets(t):
        import re

        tokens = re.findall(r"[a-z0-9]+|[一-鿿]", t)
        return {tuple(tokens[k : k + 3]) for k in range(len(tokens) - 2)}

    want = len(sets(a) & sets(b)) / len(sets(a) | sets(b))
    assert jaccard([a, "x"], [b, "x"]).tolist() == pytest.approx([want, 0.0])


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}


@pytest.mark.parametrize(
    "text, plain, found",
    [
        ("Se﻿ni​or ", "Senior ", True), ("15 μs β 版本", "15 μs β 版本", False), ("533712Χ 仅", "533712X 仅", True), ("ＲａｖFlow１", "RavFlow1", True),
        ("Orélie", "Orélie", True), ("Orélie", "Orélie", False), ("Rеtriеνal Cοnsult", "Retrieval Consult", True), ("⽹络", "网络", True), ("trade-oﬀs", "trade-offs", True),
        ("，（甲）：！", "，（甲）：！", False), ("a b　c", "a b c", True), ("tab\tline\n", "tab\tline\n", False), ("mira17＠post", "mira17@post", True), ("𝐀𝟏", "A1", True), ("", "", False),
    ],
)
def test_stand_ins(text, plain, found):
    assert (plain_form(text), bool(stand_ins(text))) == (plain, found)
    assert skeleton(text) == skeleton(plain)


def test_forms(spark):
    df = spark.createDataFrame([(1, "Αb", None, "s"), (2, "plain", "甲​乙", "s"), (2, "plain", "甲​乙", "s"), (3, "", "x" * 30_000 + "　", "s")], "id int, a string, b string, skeleton string")
    got = sorted((r["id"], r["field_name"], r["plain"] if r["plain"] is None else r["plain"][:6], r["stand_ins"]) for r in with_forms(df, "id", ["a", "b"]).collect() if r["plain"] is not None)
    assert got == [(1, "a", "Ab", 1), (2, "a", "plain", 0), (2, "a", "plain", 0), (2, "b", "甲乙", 1), (2, "b", "甲乙", 1), (3, "a", "", 0), (3, "b", "xxxxxx", 1)]
    assert with_forms(df.limit(0), "id", ["a", "b"]).count() == 0
    values = spark.createDataFrame([("Acme",), ("Ａcme",), ("Асmе",), ("Acme",), (None,), ("Other",)], "v string")
    assert {(r["plain"], r["spellings"], r["rows"]) for r in equal_looking(values, "v").collect()} == {("Acme", 3, 4), ("Other", 1, 1)}


@pytest.mark.parametrize(
    "text, plain, found",
    [
        ("Py\u0442hon", "Python", True), ("\u043aaf\u043aa", "kafka", True), ("Sca\u04cfa", "Scala", True), ("d\u03b1ta", "data", True), ("d\u0435v\u03b5loper", "developer", True),
        ("\u13aapache", "Apache", True), ("\u2c9eracle", "Oracle", True), ("we\u0436b", "we\u0436b", True), ("syste\u043c", "system", True),
        ("15 μs", "15 μs", False), ("10kΩ 5\u00b5m", "10kΩ 5\u00b5m", False), ("μmol ΔT TNFα β版本 α-test 5Ω", "μmol ΔT TNFα β版本 α-test 5Ω", False), ("бить в длинный", "бить в длинный", False), ("5 км 3к", "5 км 3к", False),
    ],
)
def test_letters_of_other_scripts(text, plain, found):
    assert (plain_form(text), bool(stand_ins(text))) == (plain, found)
    assert skeleton(text) == skeleton(plain)


@pytest.mark.parametrize("text", ["оркестр", "хор пел", "Дом, сорок и один", "Ελλάδα και Όμηρος", "Орел 5 км", "café Ångström 豈"])
def test_whole_words_of_other_scripts_stay(text):
    assert (plain_form(text), stand_ins(text)) == (text, [])


def test_confusables_of_unicode(spark):
    from jobweave.llm import skeleton as module

    table = module.confusables(spark)
    assert len(table) > 200 and all(len(v) == 1 and v.isascii() for v in table.values())
    odd = {"\ua4d0ase": "Base", "\U00010404racle": "Oracle", "\u1d00pp\u029f\u1d07": "apple", "\u13daalary": "Salary", "d\u03b1ta": "data"}
    df = spark.createDataFrame([(k, t) for k, t in enumerate(odd)] + [(90, "оркестр"), (91, "plain"), (92, None)], "id int, t string")
    got = {r["id"]: (r["plain"], r["stand_ins"] or 0) for r in module.with_forms(df, "id", ["t"]).collect()}
    assert [got[k][0] for k in range(len(odd))] == list(odd.values()) and all(got[k][1] for k in range(len(odd)))
    assert (got[90], got[91], got[92]) == (("оркестр", 0), ("plain", 0), (None, 0))
    flagged = {r["id"] for r in module.looking_alike(df, "id", ["t"]).collect()}
    assert flagged == {k for k, (_, n) in got.items() if n}


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("p6_")])
def test_without_icu_there_is_an_error(spark, folder, monkeypatch, name):
    jvm = spark._jvm

    class WithoutIcu:
        com = jvm.absent  # names below it are packages without classes, as com.ibm.icu is where the library is missing

        def __getattr__(self, name):
            return getattr(jvm, name)

    monkeypatch.setattr(spark, "_jvm", WithoutIcu())
    with pytest.raises(RuntimeError, match="com.ibm.icu.text.SpoofChecker"):
        QUERIES[name](spark, folder)


def test_plain_form_changes_where_stand_ins_are(spark, folder):
    found = {tuple(r) for r in QUERIES["p6_found"](spark, folder).collect()}
    raw = {r["id"]: r for r in spark.read.parquet(f"{folder}/dataset_job_raw.parquet").collect()}
    rows = QUERIES["p6_plain"](spark, folder).collect()
    assert {(r["id"], r["field_name"]) for r in rows if r["plain"] != raw[r["id"]][r["field_name"]]} == found


def test_stand_ins_come_from_prototypes(spark, monkeypatch):
    from jobweave.llm import record_queries
    from jobweave.llm import skeleton as module

    assert stand_ins("Rеtrieval") == [1]
    monkeypatch.setattr(module, "_odd", lambda c: c == "\u200b")  # a table that knows nothing else
    assert stand_ins("Rеtri\u200beval") == [5] and stand_ins("Ａcme") == []
    monkeypatch.undo()
    # What is not sent to Python is made of characters that are their own prototypes.
    plain = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and not re.search(module._MAYBE, c)]
    assert len(plain) > 20_000 and all(module.prototype(c) == c and not stand_ins(c) for c in plain)
    for name in ("p6_titles", "p6_companies", "p6_descriptions"):
        assert name in record_queries.QUERIES


def test_every_text_is_grouped_by_its_skeleton(spark, folder):
    from jobweave.sources.tables import table

    for name, field in (("p6_titles", "title"), ("p6_companies", "company"), ("p6_descriptions", "description")):
        texts = [r[0] for r in table(spark, folder, "raw_job").select(field).collect() if r[0] is not None]
        want = {k: (len(set(g)), len(g)) for k, g in ((k, list(g)) for k, g in itertools.groupby(sorted(texts, key=skeleton), key=skeleton))}
        assert {r["skeleton"]: (r["spellings"], r["rows"]) for r in QUERIES[name](spark, folder).collect()} == want


ROLES = [(1, "隐私采集工程师"), (2, "矿山集成工程师"), (3, "渲染架构研究员"), (4, "Edge Integration Engineer"), (5, "Battery Platform Engineer"), (6, None)]


def test_canonical(spark):
    cases = {
        "高级隐私采集工程师（急招）": 1, "工程师-隐私采集": 1, "隐私采​集岗": 1, "矿集山成工程师": 2, "渲染架流研究员": 3, "Sr. Integration / Edge Eng.": 4, "EdgeIntegration engineer": 4, "battrey platform developer": 5, "厨师长": None, "法务助理": None,
    }
    rows = [(t, "n") for t in cases] * 2 + [(None, "n"), ("  ", "n"), ("", "n"), ("长" * 20_000, "n")]
    roles = spark.createDataFrame(ROLES, "id int, role_name string")
    values = spark.createDataFrame(rows, "title string, normal string")
    for limit in (20_000, 1):
        got = {r["title"]: r for r in match_values(values, "title", roles, "id", "role_name", 0.43, 0.01, reference_limit=limit).collect()}
        assert {t: got[t]["entry"] for t in cases} == cases
        assert set(got) == {*cases, "长" * 20_000} and all(got[t]["rows"] == 2 for t in cases)
    assert match_values(values, "title", roles.limit(0), "id", "role_name").where("entry is not null").count() == 0
    assert match_values(values.limit(0), "title", roles, "id", "role_name").count() == 0
    assert grams("ab 数据库") == ["^ab", "ab$", "数", "数据", "据", "据库", "库"] and normal_value("ＡｂC  x") == "abc x"


def test_common_grams_count_at_every_list_size(spark):
    values = spark.createDataFrame([("工程师",), ("高级工程师",), ("采购",)], "title string")
    scores = []
    for n in (2, 19, 20, 200):
        roles = spark.createDataFrame([(1, "工程师")] + [(k, f"{chr(0x5000 + k)}{chr(0x6000 + k)}工程师") for k in range(2, n + 1)], "id int, role_name string")
        got = {r["title"]: r for r in match_values(values, "title", roles, "id", "role_name", 0.43, 0.01).collect()}
        assert {t: r["entry"] for t, r in got.items()} == {"工程师": 1, "高级工程师": 1, "采购": None}, n
        scores.append(got["工程师"]["runner_up"])
    # A shared common part weighs less the longer the list, without a step.
    assert scores == sorted(scores, reverse=True) and 0 < scores[2] and scores[1] - scores[2] < 0.05
