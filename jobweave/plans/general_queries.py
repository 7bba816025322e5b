"""Queries of the general problems 4 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.operators.multivalue import split_values
from jobweave.operators.timestamps import iso_utc, normalise_timestamps
from jobweave.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """(id, posted_utc) of every posting whose posting_date states a real date."""
    raw = table(spark, folder, "raw_job").select("id", "source_dataset", "posting_date", "posting_year")
    known = normalise_timestamps(raw, table(spark, folder, "source_feed")).where(F.col("instant_utc").isNotNull())
    return known.select("id", iso_utc(F.col("instant_utc")).alias("posted_utc"))


def p4_unreadable_by_feed(spark: SparkSession, folder: str) -> DataFrame:
    """(source_dataset, postings, readable, span of instants): how well each feed's dates can be read."""
    raw = table(spark, folder, "raw_job").select("id", "source_dataset", "posting_date", "posting_year")
    known = normalise_timestamps(raw, table(spark, folder, "source_feed"))
    return known.groupBy("source_dataset").agg(
        F.count(F.lit(1)).alias("postings"),
        F.count("instant_utc").alias("readable"),
        F.min(iso_utc(F.col("instant_utc"))).alias("earliest_utc"),
        F.max(iso_utc(F.col("instant_utc"))).alias("latest_utc"),
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, row_id, item_pos, item_value) of skill.aliases and dataset_job_raw.industry."""
    aliases = split_values(table(spark, folder, "skill"), "id", "aliases", "skill")
    industry = split_values(table(spark, folder, "raw_job"), "id", "industry", "dataset_job_raw")
    return aliases.unionByName(industry)


QUERIES = {"p4_found": p4_found, "p4_unreadable_by_feed": p4_unreadable_by_feed, "p5_found": p5_found}
SQL: dict[str, str] = {}
