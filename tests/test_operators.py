"""Operators on small tables: merging, duplicates, streaming, files, profiles, graph."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from jobweave.operators import documents as D
from jobweave.operators import extraction as X
from jobweave.operators import governance as G
from jobweave.operators import graph
from jobweave.operators.resume import parse_profile, parse_profiles
from jobweave.operators.schema_map import canonical, find_columns
from jobweave.sources.files import decode_text, docx_text, query_jdbc, read_jdbc, read_postings_csv, read_snapshot, read_texts, write_jdbc, write_snapshot
from jobweave.sources.generator import postings
from jobweave.streaming.events import windowed_counts
from jobweave.streaming.governing import progress, start_governing


def test_schema_map(spark):
    df = spark.createDataFrame([(1, " t ", "d", "2020-1", "面议", "2024-05-06 x"), (2, None, None, "1999", "12,000元", "bad")], "`Job-ID` int, `招聘岗位` string, `职位描述` string, `年份` string, `最低月薪` string, `发布日期` string")
    a, b = canonical(df).orderBy("raw_id").collect()
    assert (a["raw_title"], str(a["published_at"]), a["published_year"], a["salary_min"], a["company"]) == ("t", "2024-05-06", 2020, None, "")
    assert (b["raw_title"], str(b["published_at"]), b["published_year"], float(b["salary_min"])) == ("", "1999-01-01", 1999, 12000.0)
    with pytest.raises(ValueError):
        find_columns(["id", "title"])
    assert canonical(df.limit(0)).count() == 0


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 0, 0), (2, "b", 1, 0), (3, "c", 0, 1)], "id int, v string, manual_modified int, is_deleted int")
    new = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "D")], "id int, v string")
    assert {r["id"]: r["v"] for r in G.merge_jobs(old, new, "id", ["v"]).collect()} == {1: "A", 2: "b", 3: "c", 4: "D"}
    edits = spark.createDataFrame([(1, "x", None, 1), (1, "y", "w", 2), (1, None, None, 3)], "id int, v string, u string, t int")
    base = spark.createDataFrame([(1, "o", "p"), (2, "q", "r")], "id int, v string, u string")
    assert {tuple(r) for r in G.fold_edits(base, edits, "id", ["v", "u"], ["t"]).collect()} == {(1, "y", "w", 3), (2, "q", "r", 0)}
    held = G.holdout_sample(spark.range(1, 101).selectExpr("id", "2026 as posting_year"), 2026, 10)
    assert held.count() == 10 and G.without_holdout(spark.range(1, 101), held, "id").count() == 90
    again = G.holdout_sample(spark.range(1, 101).repartition(7).selectExpr("id", "2026 as posting_year"), 2026, 10)
    assert held.exceptAll(again).count() == 0


def test_duplicates(spark):
    rows = [(1, "h", 0, 1, 0, "CLEANED"), (2, "h", 0, 1, 0, "CLEANED"), (3, "h", 0, 0, 0, "LOW"), (4, "h", 1, 1, 0, "DEL"), (5, "g", 0, 1, 0, "CLEANED"), (6, None, 0, 1, 1, "MINE")]
    df = spark.createDataFrame(rows, "raw_job_id int, template_hash string, is_deleted int, valid_for_analysis int, manual_modified int, governance_status string")
    got = {r[0]: tuple(r)[1:] for r in G.finish_duplicates(df).collect()}
    assert got == {1: ("TPL-1", 0.707107, "DUPLICATE_REVIEW"), 2: ("TPL-1", 0.707107, "DUPLICATE_REVIEW"), 3: ("TPL-1", 0.707107, "DUPLICATE_REVIEW"), 5: (None, 1.0, "CLEANED"), 6: (None, 1.0, "MINE")}


def test_governing_stream_resumes(spark, tmp_path):
    raw = postings(spark, 60)
    raw.where("id <= 30").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    run = lambda: start_governing(spark, f"{tmp_path}/in/*", raw.schema, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    assert run() and progress(spark, f"{tmp_path}/out").first()["rows"] == 30
    raw.where("id > 30").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    assert run() and run()
    got = progress(spark, f"{tmp_path}/out").first()
    assert (got["rows"], got["last_id"], got["batches"]) == (60, 60, 2)


def test_event_stream_equals_batch(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(f"{folder}/events.parquet*"), lateness="1 hour")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    assert q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("events")).first()[0] == events.count()


def test_unknown_years_are_stale(spark):
    years = spark.createDataFrame([(2026,), (2018,), (2000,), (None,)], "y int")
    assert [r[0] for r in years.select(G.staleness(F.col("y"), 2026)).collect()] == [0.0, 1.0, 1.0, 1.0]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿招聘岗位,职位描述,最低月薪,企业名称\n 工程师 ,"多行\n描述",面议,甲\n工程师,"多行 描述",100,甲\n经理,x,9000.5,乙\n', "utf-8")
    rows = {r["title"]: r for r in read_postings_csv(spark, str(tmp_path / "a.csv"), "d").collect()}
    assert set(rows) == {"工程师", "经理"} and float(rows["经理"]["salary_min"]) == 9000.5
    assert [decode_text(x) for x in ("汉字".encode("gb18030") * 50, b"\xff\xfe" + "x汉".encode("utf-16-le"), "汉".encode())] == ["汉字" * 50, "x汉", "汉"]
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>d</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", xml)
    assert docx_text(buffer.getvalue()) == "a\tb\nc | d" and docx_text(b"no") == ""
    (tmp_path / "f").mkdir()
    (tmp_path / "f/x.docx").write_bytes(buffer.getvalue())
    assert [r["text"] for r in read_texts(spark, str(tmp_path / "f")).collect()] == ["a\tb\nc | d"]


def test_snapshots_switch_as_a_whole(spark, tmp_path):
    path = f"file://{tmp_path}/snap"
    df = spark.range(3).toDF("id")
    assert read_snapshot(spark, path, df).count() == 3
    with pytest.raises(FileNotFoundError):
        read_snapshot(spark, path)
    first = write_snapshot(df, path)
    old = read_snapshot(spark, path)
    second = write_snapshot(df.limit(1), path)
    assert first != second and old.count() == 3 and read_snapshot(spark, path).count() == 1
    broken = df.select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        write_snapshot(broken, path)
    assert read_snapshot(spark, path).count() == 1


def test_databases(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    df = spark.range(1, 101).selectExpr("id", "concat('n', id) as name", "cast(id % 7 as double) as v")
    write_jdbc(df, url, "jobs", driver=driver)
    write_jdbc(spark.createDataFrame([(101, "x", None)], "id long, name string, v double"), url, "jobs", driver=driver)
    got = read_jdbc(spark, url, "jobs", "id", 1, 101, 4, driver)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 101 and got.where("v is null").first()["name"] == "x"
    assert query_jdbc(spark, url, 'select count(*) as n, max("v") as m from jobs where "id" > 50', driver).first()[:] == (51, 6.0)


def test_loads_keep_rows_without_a_hash(spark):
    rows = [(1, "a", "h"), (2, "a", "h"), (3, "a", None), (4, "a", None), (5, "a", " "), (6, "b", "h")]
    df = spark.createDataFrame(rows, "id int, source_dataset string, content_hash string")
    assert sorted(r["id"] for r in G.deduplicate_load(df).collect()) == [1, 3, 4, 5, 6]


def test_generator_is_the_same_for_any_partitions(spark):
    a = postings(spark, 500)
    assert a.exceptAll(postings(spark, 500).repartition(13)).count() == 0
    assert a.groupBy("description").count().where("count > 1 and description is not null").count() > 0


RESUME = """姓名：王小明
电话 13800000000
教育背景
2012.09-2016.06 东港大学 计算机科学专业 本科
工作经历
2018.01-2019.12 甲公司 工程师
2019.06-至今 乙公司
项目经历
1. 数据平台
- 检索系统
专业技能
语言：Java、Python，SQL"""


def test_profiles(spark):
    p = parse_profile(RESUME, (2020, 12))
    assert (p["name"], p["degree"], p["school"], p["months"], p["years"], p["skills"], p["projects"], p["has_contact"]) == ("王小明", "本科", "东港大学", 36, 3.0, ["Java", "Python", "SQL"], 2, True)
    df = spark.createDataFrame([(1, RESUME), (2, ""), (3, None), (4, "x" * 50_000)], "id int, text string")
    assert {r["id"] for r in parse_profiles(df, "id", "text").collect()} == {1, 4}


def test_mentions_and_copies(spark):
    names = X.dictionary(spark.createDataFrame([(1, "Spark SQL"), (2, "C"), (3, "Go"), (4, None)], "id long, canonical_name string"), spark.createDataFrame([(1, 1, "sparksql")], "row_id long, item_pos long, item_value string"))
    texts = spark.createDataFrame([(1, "必须 SPARKSQL"), (2, "go c"), (3, None), (4, "")], "id int, text string")
    got = X.skill_mentions(texts, names, "id", "text").collect()
    assert [(r["id"], r["skill_id"], r["place"], r["kind"], r["confidence"]) for r in got] == [(1, 1, 4, "REQUIRED", 0.94)]
    many = X.skill_mentions(texts, names, "id", "text", limit=1).collect()
    assert [(r["id"], r["skill_id"]) for r in many] == [(1, 1)]
    both = spark.createDataFrame([(1, "Spark"), (1, "spark sql 与 hive"), (2, "HIVE" * 50), (2, "HIVE" * 50), (3, "sp ark")], "id int, text string")
    more = X.dictionary(spark.createDataFrame([(1, "Spark SQL"), (2, "hive"), (3, "Spark"), (4, "spark")], "id long, canonical_name string"))
    assert sorted(map(tuple, X.skill_mentions(both, more, "id", "text", limit=1).collect())) == sorted(map(tuple, X.skill_mentions(both, more, "id", "text").collect()))
    sets = spark.createDataFrame([(1, "aa bb cc dd ee"), (2, "aa bb cc dd ee ff"), (3, "zz yy"), (4, "EE dd cc bb aa"), (5, None), (6, "")], "id int, text string")
    assert [tuple(r) for r in D.similar_token_sets(sets, "id", "text").collect()] == [(1, 2, 0.833333)]


def test_expand(spark):
    relation = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", "y")], "role_name string, skill_name string")
    seeds = spark.createDataFrame([("R:a",)], "node string")
    assert {tuple(r) for r in graph.expand(relation, seeds, 3).collect()} == {("R:a", 0), ("S:x", 1), ("R:b", 2), ("S:y", 3)}
