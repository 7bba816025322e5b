"""Listings and counters around the analyses: options, role skills, recency, modes, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions.measures import analysable, blank_null, double, evidence, filled
from jobweave.operators.market import BONUS_TYPES, titled, with_jobs

# Order in which levels are shown.
LEVEL_ORDER = ("初级", "中级", "高级")


def graph_options(jobs: DataFrame, stacks: int = 40) -> DataFrame:
    """(kind, value, rows, place): the most frequent stacks, and the levels in their order."""
    rows = jobs.where(analysable() & titled())
    by = lambda c, kind, default: rows.groupBy(filled(c, default).alias("value")).agg(F.count(F.lit(1)).alias("rows")).withColumn("kind", F.lit(kind))
    top = by("tech_stack", "stack", "未分类").orderBy(F.desc("rows"), F.asc("value")).limit(stacks)
    ranked = top.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("rows"), F.asc("value"))))  # at most `stacks` rows
    order = F.lit(len(LEVEL_ORDER) + 1)
    for k, level in enumerate(LEVEL_ORDER):
        order = F.when(F.col("value") == level, k + 1).otherwise(order)
    levels = by("level_name", "level", "未标注").withColumn("place", order)
    return ranked.select("kind", "value", "rows", "place").unionByName(levels.select("kind", "value", "rows", "place"))


def role_skills(skills: DataFrame, jobs: DataFrame, year: int, required: int = 8, bonus: int = 6, fill_required: int = 5) -> DataFrame:
    """(role, part, skill_name, place): required and bonus skills of each role of a year.

    Required skills are the strongest marked so; with fewer than ``fill_required`` of them the
    strongest without a bonus mark follow. Bonus skills are the strongest marked so that are
    not among the required ones. Filling is part of the ranking key, so one window each decides.
    """
    joined = with_jobs(skills, jobs, analysable() & titled() & (F.col("published_year") == year), "title_standard")
    part = lambda cond: F.sum(F.when(cond, F.col("support")).otherwise(F.lit(0.0)))
    per = joined.groupBy(F.trim("title_standard").alias("role"), "skill_name").agg(
        F.round(part(F.col("kind") == "REQUIRED"), 6).alias("r"), F.round(part(F.col("kind").isin(*BONUS_TYPES)), 6).alias("b"), F.round(part(~F.col("kind").isin(*BONUS_TYPES)), 6).alias("u")
    )
    of_role = Window.partitionBy("role")
    marked = F.sum((F.col("r") > 0).cast("int")).over(of_role)
    eligible = (F.col("r") > 0) | ((marked < fill_required) & (F.col("u") > 0))
    ranked = per.withColumn("eligible", eligible).withColumn("place", F.row_number().over(of_role.orderBy(F.desc("eligible"), F.desc(F.col("r") > 0), F.desc("r"), F.desc("u"), F.asc("skill_name"))))
    chosen = ranked.withColumn("needed", F.col("eligible") & (F.col("place") <= required))
    rest = chosen.where(~F.col("needed") & (F.col("b") > 0)).withColumn("place", F.row_number().over(of_role.orderBy(F.desc("b"), F.asc("skill_name")))).where(F.col("place") <= bonus)
    return chosen.where("needed").select("role", F.lit("required").alias("part"), "skill_name", "place").unionByName(rest.select("role", F.lit("bonus").alias("part"), "skill_name", "place"))


def last_per_key(df: DataFrame, key: str, time_col: str, tie: str, k: int = 6) -> DataFrame:
    """The last ``k`` rows of each key with their place in chronological order."""
    newest = df.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time_col), F.desc(tie)))).where(F.col("back") <= k)
    return newest.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("back")))).drop("back")


def dominant(df: DataFrame, key: Column, value: str) -> DataFrame:
    """(key, value, rows, values): the most frequent value of each key, the smallest among equals."""
    counted = df.where(key.isNotNull()).groupBy(key.alias("key"), blank_null(value).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("value is not null")
    return counted.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("o"), "value"))["value"].alias("value"), F.max("n").alias("rows"), F.count(F.lit(1)).alias("values"))


def evidence_modes(jobs: DataFrame) -> DataFrame:
    """Rows, distinct evidence and weighted rows per year: the three ways to count postings."""
    return jobs.where(analysable()).groupBy("published_year").agg(F.count(F.lit(1)).alias("rows"), evidence().alias("distinct_evidence"), F.round(F.sum(double("duplicate_weight")), 3).alias("weighted"))


def pending(jobs: DataFrame, skills: DataFrame, low_confidence: float = 0.75) -> DataFrame:
    """What waits for a review, from two tables of different columns, riskiest first by ``risk``."""
    postings = jobs.where((F.col("is_deleted") == 0) & (F.col("governance_status") == "DUPLICATE_REVIEW")).select(F.lit("posting").alias("kind"), F.col("raw_job_id").alias("id"), "title_standard", F.round(1 - F.coalesce(double("quality_score"), F.lit(0.0)), 6).alias("risk"))
    relations = skills.where(double("confidence") < low_confidence).select(F.lit("relation").alias("kind"), "id", "skill_name", F.round(1 - double("confidence"), 6).alias("risk"))
    return postings.unionByName(relations, allowMissingColumns=True)


def changed_sets(skills: DataFrame, jobs: DataFrame, old: int, new: int) -> DataFrame:
    """(role, added, dropped, kept, similarity): skill sets of a role in two years, by set operations on arrays."""
    joined = with_jobs(skills, jobs, analysable() & titled() & F.col("published_year").isin(old, new), "title_standard", "published_year")
    sets = joined.groupBy(F.trim("title_standard").alias("role")).agg(*[F.collect_set(F.when(F.col("published_year") == y, F.col("skill_name"))).alias(n) for y, n in ((old, "a"), (new, "b"))])
    sets = sets.where((F.size("a") > 0) & (F.size("b") > 0))
    size = F.size
    return sets.select("role", size(F.array_except("b", "a")).alias("added"), size(F.array_except("a", "b")).alias("dropped"), size(F.array_intersect("a", "b")).alias("kept"), F.round(size(F.array_intersect("a", "b")) / size(F.array_union("a", "b")), 6).alias("similarity"))
