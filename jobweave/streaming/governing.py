"""Continuous governance: new posting files are governed in micro-batches as they arrive.

The checkpoint holds the progress, so a stopped run goes on where it was; each batch
overwrites its own folder, so that a batch repeated after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from jobweave.operators.governance import govern, issues
from jobweave.operators.schema_map import canonical


def start_governing(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, files_per_batch: int = 8, as_of: int = 2026) -> StreamingQuery:
    """Govern all files of ``source`` that were not governed before, then stop."""

    def write(batch: DataFrame, number: int) -> None:
        governed = govern(canonical(batch), as_of=as_of).persist()
        governed.write.mode("overwrite").parquet(f"{target}/jobs/batch={number}")
        issues(governed).write.mode("overwrite").parquet(f"{target}/issues/batch={number}")
        governed.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(spark: SparkSession, target: str) -> DataFrame:
    """Counters over all batches: rows, valid rows, batches, last id."""
    jobs = spark.read.option("basePath", f"{target}/jobs").parquet(f"{target}/jobs")
    return jobs.agg(F.count(F.lit(1)).alias("rows"), F.sum("valid").alias("valid"), F.countDistinct("batch").alias("batches"), F.max("raw_id").alias("last_id"))
