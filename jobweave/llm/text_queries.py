"""Queries of problem 2: personal data in descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.personal_data import personal_data_kinds, redacted
from jobweave.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """(id, pii_kind): kinds of personal data in each posting's description."""
    return personal_data_kinds(table(spark, folder, "raw_job").select("id", "description"), "id", "description")


def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """(id, redacted): every description with typed placeholders."""
    raw = table(spark, folder, "raw_job").select("id", "description")
    return redacted(raw, "description").select("id", "redacted")


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    """(source_dataset, pii_kind, postings): how often each feed shows each kind."""
    raw = table(spark, folder, "raw_job").select("id", "source_dataset", "description")
    found = personal_data_kinds(raw.select(F.struct("id", "source_dataset").alias("key"), "description"), "key", "description")
    return found.groupBy("key.source_dataset", "pii_kind").agg(F.count(F.lit(1)).alias("postings"))


QUERIES = {f.__name__: f for f in (p2_found, p2_redacted, p2_rates)}
SQL: dict[str, str] = {}
