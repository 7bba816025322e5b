"""Queries of problems 8, 9 and 10: packing, leaks, abusive content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.abuse import fit_machine, score_documents
from jobweave.llm.leaks import find_leaks, removal_spans
from jobweave.llm.packing import fill_report, pack, token_counts
from jobweave.sources.tables import table


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    """(container_id, place, doc_id, piece, first_token, n_tokens): documents in containers of 2 048 tokens."""
    return pack(token_counts(_documents(spark, folder), "doc_id", "text")).withColumnRenamed("id", "doc_id")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """(containers, least, tokens, unused_share) of the packing of documents."""
    return fill_report(pack(token_counts(_documents(spark, folder), "doc_id", "text")))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(_documents(spark, folder), table(spark, folder, "eval_item").select("item_id", "text"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, item_id): documents with a passage that holds at least half of an evaluation item."""
    return _leaks(spark, folder).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, documents, share): leaked items, in how many documents and how completely at most."""
    return _leaks(spark, folder).groupBy(F.col("item").alias("item_id")).agg(F.countDistinct("doc").alias("documents"), F.max("share").alias("share"))


def p9_spans(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, spans): merged passages to remove from each document."""
    return removal_spans(_leaks(spark, folder)).withColumnRenamed("doc", "doc_id")


ABUSE_LIMIT = 0.5


def _scores(spark: SparkSession, folder: str, *columns: str, refit: bool = False) -> DataFrame:
    documents = table(spark, folder, "documents")
    machine = fit_machine(documents, table(spark, folder, "doc_label"), refit=refit)
    return score_documents(documents.select("doc_id", "text", *columns), machine)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id) of documents whose worst passage is abusive, hateful or sexual more likely than not.

    Fits the machine and saves it; the other two queries read the saved one.
    """
    return _scores(spark, folder, refit=True).where(F.col("abuse_score") >= ABUSE_LIMIT).select("doc_id")


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, abuse_score) of every document."""
    return _scores(spark, folder).select("doc_id", "abuse_score")


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """(source, documents, flagged, rate, mean_score) per source."""
    flagged = (F.col("abuse_score") >= ABUSE_LIMIT).cast("int")
    return _scores(spark, folder, "source").groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(flagged).alias("flagged"), F.avg(flagged).alias("rate"), F.avg("abuse_score").alias("mean_score")
    )


QUERIES = {f.__name__: f for f in (p8_packed, p8_report, p9_found, p9_items, p9_spans, p10_found, p10_scores, p10_rates)}
SQL: dict[str, str] = {}
