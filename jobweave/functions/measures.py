"""Column expressions that the analyses share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(value: Column | str, default: str) -> Column:
    """Trimmed value, or ``default`` where nothing is left."""
    return F.coalesce(blank_null(value), F.lit(default))


def blank_null(value: Column | str) -> Column:
    """Trimmed value, null where nothing is left."""
    return F.nullif(F.trim(value), F.lit(""))


def evidence_key(group: str = "duplicate_group", row_id: str = "raw_job_id") -> Column:
    """A duplicate group counts as one piece of evidence, a row outside groups by itself."""
    return F.coalesce(blank_null(group), F.concat(F.lit("U-"), F.col(row_id).cast("string")))


def evidence(where: Column | None = None) -> Column:
    key = evidence_key()
    return F.countDistinct(key if where is None else F.when(where, key))


def distinct_filled(value: str) -> Column:
    return F.countDistinct(blank_null(value))


def analysable() -> Column:
    return (F.col("valid_for_analysis") == 1) & (F.col("is_deleted") == 0)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def saturation(count: Column, full: float) -> Column:
    """ln(1 + count) / ln(full), between 0 and 1."""
    return clamp(F.log1p(count.cast("double")) / F.log(F.lit(float(full))))


def double(column: str) -> Column:
    return F.col(column).cast("double")


def first_half(column: str = "published_at") -> Column:
    return F.month(column) <= 6


def momentum(h1: Column, h2: Column) -> Column:
    """0.5 when both halves of the year are level, above when the second is stronger, 0 without dates."""
    return F.when(h1 + h2 == 0, F.lit(0.0)).otherwise(clamp(0.5 + 0.5 * (h2 - h1) / (h1 + h2)))
