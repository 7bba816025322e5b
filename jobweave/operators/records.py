"""Keeping derived records: keyed and additive merging, reviewed rows, decisions, edits, and what a reader looks up.

Merges are folds over append-only rows: union, one aggregation on the key, no update in place.
A hot key is pre-aggregated before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions.evidence import stable_key
from jobweave.functions.measures import blank_null, double


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows of both by key; where both have one, the new values. Of several new rows with a key the greatest values win."""
    marked = lambda df, turn: df.select(*keys, F.struct(F.lit(turn).alias("turn"), *values).alias("v"))
    best = marked(old, 0).unionByName(marked(new, 1)).groupBy(*keys).agg(F.max("v").alias("v"))
    return best.select(*keys, *[f"v.{c}" for c in values])


def added(state: DataFrame, batch: DataFrame, keys: Sequence[str], sums: Sequence[str], least: Sequence[str] = (), greatest: Sequence[str] = ()) -> DataFrame:
    """Partial aggregates merged: sums add up, extremes stay extremes. The same for any order and split of batches."""
    both = state.unionByName(batch)
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in greatest])


def replaced(existing: DataFrame, fresh: DataFrame, status: str, automatic: str) -> DataFrame:
    """Reviewed rows of ``existing`` with all of ``fresh``: automatic rows give way to the new ones."""
    return existing.where(~F.coalesce(F.col(status) == automatic, F.lit(False))).unionByName(fresh, allowMissingColumns=True)


def appended(candidates: DataFrame, run_key: Sequence[Column], evidence: Sequence[str], *columns: str) -> DataFrame:
    """(run_id, ``columns``, evidence_json): candidates of a run; the run's id is a hash of what it ran on."""
    return candidates.select(stable_key(*run_key).alias("run_id"), *columns, F.to_json(F.struct(*evidence)).alias("evidence_json"))


def reviewed(rows: DataFrame, decisions: DataFrame, key: str, patched: Sequence[str], status: str, order: Sequence[str]) -> DataFrame:
    """``rows`` after their last decision: stated values patch the old ones, an approval publishes, a rejection closes.

    ``decisions`` has the key, ``decision`` (APPROVE, REJECT, anything else keeps the status),
    the patched columns (null states nothing) and the ``order`` columns. ``changed`` counts
    the patched columns whose value is another one now.
    """
    last = decisions.groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct("decision", *patched), F.struct(*order)).alias("d"))
    joined = rows.join(last, F.col(key) == F.col("__k"), "left")
    after = {c: F.coalesce(F.col(f"d.{c}"), F.col(c)) for c in patched}
    moved = F.when(F.col("d.decision") == "APPROVE", "PUBLISHED").when(F.col("d.decision") == "REJECT", "REJECTED").otherwise(F.col(status))
    changed = sum((F.when(~v.eqNullSafe(F.col(c)), 1).otherwise(0) for c, v in after.items()), F.lit(0))
    return joined.select(key, *[v.alias(c) for c, v in after.items()], moved.alias(status), changed.alias("changed"))


def edited_skills(skills: DataFrame, edits: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(keys, origin): the relation after edits that add or delete single skills; the last edit of a key decides."""
    last = edits.groupBy(*keys).agg(F.max_by("action", F.struct(*order)).alias("action"))
    joined = skills.select(*keys).distinct().withColumn("had", F.lit(True)).join(last, list(keys), "full_outer")
    kept = joined.where(F.coalesce(F.col("action") == "ADD", F.col("had") & F.col("action").isNull(), F.lit(False)))
    return kept.select(*keys, F.when(F.col("had"), "LOADED").otherwise("MANUAL").alias("origin"))


def published(roles: DataFrame, needs: DataFrame, skills: DataFrame, status: str = "PUBLISHED") -> DataFrame:
    """(role_id, role, skill_id, skill, kind, importance): requirements of listed roles in a status, with the skills they name."""
    listed = roles.where(F.col("status") == status).select(F.col("id").alias("role_id"), F.trim("role_name").alias("role"))
    named = skills.where("canonical_name is not null").select(F.col("id").alias("skill_id"), F.col("canonical_name").alias("skill_name"))
    return needs.join(listed, "role").join(named, "skill_name").select("role_id", "role", "skill_id", F.col("skill_name").alias("skill"), "kind", "importance")


def best_evidence(relation: DataFrame, skills: DataFrame, jobs: DataFrame, k: int = 8) -> DataFrame:
    """(role, skill, evidence_id, place): the ``k`` surest pieces of evidence of each role and skill of ``relation``."""
    titled = jobs.select("raw_job_id", F.trim("title_standard").alias("role"))
    rows = skills.where("evidence_text is not null").select("id", "raw_job_id", F.col("skill_name").alias("skill"), double("confidence").alias("c")).join(titled, "raw_job_id")
    kept = rows.join(relation.select("role", "skill").distinct(), ["role", "skill"], "left_semi")
    order = Window.partitionBy("role", "skill").orderBy(F.desc_nulls_last("c"), F.asc("id"))
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("role", "skill", F.col("id").alias("evidence_id"), "place")


def status_of_each(keys: DataFrame, key: str, runs: DataFrame, run_key: str, status: str, order: Sequence[Column], default: str = "READY") -> DataFrame:
    """(key, status, runs): the last run's status of every listed key, ``default`` for one that never ran."""
    newest = runs.groupBy(F.lower(blank_null(run_key)).alias("__k")).agg(F.max_by(F.col(status), F.struct(*order)).alias("s"), F.count(F.lit(1)).alias("runs"))
    joined = keys.select(F.col(key).alias("key"), F.lower(blank_null(key)).alias("__l")).distinct().join(newest, F.col("__l") == F.col("__k"), "left")
    return joined.select("key", F.coalesce("s", F.lit(default)).alias("status"), F.coalesce("runs", F.lit(0)).alias("runs"))


def readiness(raw: DataFrame, jobs: DataFrame, snapshot_rows: int, least: int = 100) -> DataFrame:
    """One row: rows processed, valid and pending since a snapshot, and whether analyses may run."""
    total = raw.agg(F.count(F.lit(1)).alias("total"))
    done = jobs.agg(F.count(F.lit(1)).alias("processed"), F.count_if((F.col("valid_for_analysis") == 1) & (F.col("is_deleted") == 0)).alias("valid"))
    c = F.col
    both = total.crossJoin(done)  # one row each
    shown = F.when(c("processed") > 0, c("processed")).otherwise(c("total"))
    return both.select(
        "total", "processed", "valid", F.greatest(F.lit(0), c("processed") - snapshot_rows).alias("pending"), ((c("processed") >= least) & (c("valid") > 0)).alias("ready"),
        (c("processed") >= c("total")).alias("complete"), shown.alias("shown"), F.floor(c("processed") / 100).alias("version"),
    )


def daily_trend(rows: DataFrame, day: Column, days: int = 30) -> DataFrame:
    """(day, rows): the last ``days`` days that have rows, oldest first in the result."""
    counted = rows.where(day.isNotNull()).groupBy(day.cast("date").alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    return counted.orderBy(F.desc("day")).limit(days).orderBy("day")
