"""Best representative of each duplicate group, field by field.

Rows are ranked by trust, recency and quality with a total order, by window ordering, and
the first row whose value says something keeps that value. The filter ``row_number = 1`` lets
Spark cut every partition to one row per key before the shuffle, so that a group of any size
reaches its task as at most one row per input partition and field.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words and signs that stand in a field and say nothing.
FILLERS = (
    "-", "--", "---", "—", "——", "–", "/", "//", "\\", ".", "..", "...", "…", "*", "?", "？", "_", "~", "、", "#",
    "n/a", "na", "n.a.", "nan", "null", "none", "nil", "unknown", "unspecified", "undefined", "not available",
    "not specified", "not provided", "tbd", "tba", "to be added", "missing", "empty",
    "未知", "不详", "不明", "暂无", "无", "没有", "空", "待补充", "待定", "待完善", "待填写", "未填写", "未填", "未提供", "未说明", "暂缺", "暂未填写", "缺失", "其他未知",
)
BLANKS = r"[\s\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def trimmed(value: Column) -> Column:
    """Outer white space of any kind off."""
    return F.regexp_replace(value, f"^{BLANKS}|{BLANKS}$", "")


def says_nothing(value: Column, fillers: Sequence[str] = FILLERS) -> Column:
    """Null, blank or a filler."""
    bare = F.lower(trimmed(value.cast("string")))
    return bare.isNull() | (bare == "") | bare.isin(*fillers)


def group_members(df: DataFrame, group_col: str, keep: Column) -> DataFrame:
    """Rows for which ``keep`` holds and whose non-blank group has two or more such rows."""
    rows = df.where(keep & group_col_filled(group_col))
    shared = rows.groupBy(F.col(group_col).alias("__g")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__g")
    return rows.join(shared, rows[group_col] == F.col("__g"), "left_semi")


def group_col_filled(group_col: str) -> Column:
    return F.coalesce(trimmed(F.col(group_col)), F.lit("")) != ""


def surviving_values(
    members: DataFrame,
    trust: DataFrame,
    fields: Sequence[str],
    group_col: str = "duplicate_group",
    id_col: str = "raw_job_id",
    source_col: str = "source_name",
    recency_col: str = "published_at",
    quality_col: str = "quality_score",
    trust_limit: int = 100_000,
) -> DataFrame:
    """(group_col, field_name, id_col, value): of each group and field the surviving value and its origin.

    A value survives over another by the lowest ``trust.trust_rank`` of its source (case and
    outer blanks ignored; unlisted or null sources last), then the latest ``recency_col``
    (null last), then the highest ``quality_col`` (null last), then the smallest ``id_col``
    (null last), then the smallest value. Values that say nothing never survive; a field
    without any other value gives no row. Repeated rows count once. Groups are those of
    ``members`` as given; empty tables give an empty result; other columns play no part.
    A source listed twice in ``trust`` counts with its best rank; the list is broadcast up to
    ``trust_limit`` sources and joined by a shuffle beyond.
    """
    ranks = trust.groupBy(F.lower(trimmed(F.col("source_name"))).alias("__source")).agg(F.min("trust_rank").alias("__rank")).where("__source is not null")
    small = ranks.select("__source").limit(trust_limit + 1).count() <= trust_limit
    columns = [group_col, id_col, recency_col, quality_col]
    base = members.select(*columns, F.lower(trimmed(F.col(source_col))).alias("__source"), *[F.col(f).cast("string").alias(f"__v_{f}") for f in fields])
    base = base.join(F.broadcast(ranks) if small else ranks, "__source", "left")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"__v_{f}").alias("value")) for f in fields]))
    tall = base.select(*columns, "__rank", each.alias("__x")).select(*columns, "__rank", "__x.*").where(~says_nothing(F.col("value")))
    order = [F.asc_nulls_last("__rank"), F.desc_nulls_last(recency_col), F.desc_nulls_last(quality_col), F.asc_nulls_last(id_col), F.asc("value")]
    best = tall.withColumn("__k", F.row_number().over(Window.partitionBy(group_col, "field_name").orderBy(*order))).where("__k = 1")
    return best.select(group_col, "field_name", id_col, "value")


def survivors(values: DataFrame, fields: Sequence[str], group_col: str = "duplicate_group", id_col: str = "raw_job_id") -> DataFrame:
    """One record per group out of ``surviving_values``: each field with its value and, as ``<field>_from``, its origin."""
    pick = lambda f, c: F.max(F.when(F.col("field_name") == f, F.col(c)))
    return values.groupBy(group_col).agg(*[x for f in fields for x in (pick(f, "value").alias(f), pick(f, id_col).alias(f"{f}_from"))])
