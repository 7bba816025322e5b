"""Table access: every table of a data folder is one Parquet file or directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Logical name -> name of the stored table.
STORED = {
    "raw_job": "dataset_job_raw",
    "governed": "zhitu_governed_job",
    "governed_skill": "zhitu_governed_job_skill",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` (logical or stored) of ``folder``."""
    return spark.read.parquet(f"{folder}/{STORED.get(name, name)}.parquet")
