"""Synthetic postings for tests and demonstrations: seeded, with copies, gaps and stale rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TITLES = ("数据工程师", "算法工程师", "后端开发工程师", "产品经理", "测试工程师", "运维工程师")
COMPANIES = ("甲数科技", "乙云信息", "丙智软件", "丁网服务")
CITIES = ("东港", "西岭", "南屿", "北川")
SKILLS = ("Spark", "Java", "Python", "SQL", "Kafka", "Docker")


def _pick(values: tuple[str, ...], salt: int, seed: int, key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(key, F.lit(seed * 100 + salt)), F.lit(len(values))) + 1).cast("int"))


def _share(salt: int, seed: int, key: Column) -> Column:
    """A number in [0, 1) that depends on the row, the salt and the seed only."""
    return F.pmod(F.xxhash64(key, F.lit(seed * 100 + salt)), F.lit(10_000)) / 10_000.0


def postings(spark: SparkSession, rows: int, seed: int = 42, first_year: int = 2019, last_year: int = 2026, copies: float = 0.03, gaps: float = 0.02) -> DataFrame:
    """``rows`` raw postings; about ``copies`` of them repeat the row before under another company, ``gaps`` lack fields.

    Pay grows by four per cent a year from 2020. The same arguments give the same rows,
    whatever the number of partitions.
    """
    base = spark.range(1, rows + 1).withColumn("copy", _share(1, seed, F.col("id")) < copies)
    key = F.when(F.col("copy") & (F.col("id") > 1), F.col("id") - 1).otherwise(F.col("id"))
    base = base.withColumn("k", key)
    k = F.col("k")
    year = (F.lit(first_year) + F.floor(_share(2, seed, k) * (last_year - first_year + 1))).cast("int")
    day = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), F.floor(_share(3, seed, k) * 365).cast("int"))
    pay = F.round((8000 + 12000 * _share(4, seed, k)) * F.pow(F.lit(1.04), year - 2020), -2)
    title, skill_a, skill_b = _pick(TITLES, 5, seed, k), _pick(SKILLS, 6, seed, k), _pick(SKILLS, 7, seed, k)
    text = F.format_string("岗位职责：负责%s相关系统的设计与开发，推进项目落地。任职要求：熟练掌握%s，熟悉%s者优先，具备%d年以上经验。", title, skill_a, skill_b, (1 + F.floor(_share(8, seed, k) * 8)).cast("int"))
    missing = _share(9, seed, F.col("id")) < gaps
    return base.select(
        "id", F.lit("generated").alias("source_dataset"), F.format_string("gen-%06d", "id").alias("source_record_id"), title.alias("title"),
        F.when(missing, F.lit("")).otherwise(_pick(COMPANIES, 10, seed, F.col("id"))).alias("company"), _pick(CITIES, 11, seed, k).alias("city"), F.when(missing, F.lit(None)).otherwise(text).alias("description"),
        pay.cast("decimal(15,2)").alias("salary_min"), (pay * 1.4).cast("decimal(15,2)").alias("salary_max"), day.cast("string").alias("posting_date"), year.alias("posting_year"),
    )
