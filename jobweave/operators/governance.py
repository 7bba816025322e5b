"""Governance of postings: cleaning, classification, quality, duplicates, holdout, merging.

Rows are governed in one narrow projection; only duplicate groups and merges shuffle, each
on one key. A hot template or key is aggregated before it is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions.measures import double
from jobweave.functions.text import clean_description, spaces, standard_title, template_text
from jobweave.sources.scratch import spread

# Words that decide level, stack and requirement, in order.
LEVELS = (
    ("高级", "专家|首席|架构|资深|高级|senior|lead|principal|8年以上|十年以上"),
    ("中级", "中级|3-5年|3年以上|三年以上|5年以上|五年以上"),
    ("初级", "实习|应届|校招|初级|1年以下|1-3年"),
)
STACKS = (
    ("大模型应用", "大模型|智能体|agent|rag|prompt"),
    ("大数据", "hadoop|spark|flink|数仓|数据治理"),
    ("后端开发", "java|spring|微服务|后端"),
    ("物联网", "物联网|mqtt|嵌入式|边缘计算"),
    ("智能系统", "视觉|机器人|数字孪生|智能系统"),
)
REQUIREMENTS = (("PREFERRED", "优先|加分|preferred|bonus"), ("REQUIRED", "必须|要求|掌握|精通|熟练|required|must"))
CONFIDENCES = ((0.94, "必须|精通|熟练掌握|required|must"), (0.86, "要求|掌握|熟悉|优先|preferred"))
DUTY_WORDS = "职责|负责|工作内容|任职|要求|技能"
MINIMUM_QUALITY = 0.45


def first_match(text: Column, rules, default) -> Column:
    """The value of the first rule whose pattern is found."""
    out = F.lit(default)
    for value, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def infer_level(text: Column, experience: Column) -> Column:
    return first_match(F.lower(F.concat_ws(" ", text, experience)), LEVELS, "未标注")


def infer_stack(text: Column, hit_stacks: Column | None = None) -> Column:
    """The most frequent stack among ``hit_stacks`` (the earliest among equals), else by key words."""
    by_words = first_match(F.lower(text), STACKS, "人工智能")
    if hit_stacks is None:
        return by_words
    counted = F.transform(F.array_distinct(hit_stacks), lambda s, k: F.struct(F.size(F.filter(hit_stacks, lambda h: h == s)).alias("n"), (-k).alias("k"), s.alias("s")))
    return F.when(F.size(hit_stacks) > 0, F.array_max(counted)["s"]).otherwise(by_words)


def requirement_type(evidence: Column) -> Column:
    return first_match(F.lower(F.coalesce(evidence, F.lit(""))), REQUIREMENTS, "MENTIONED")


def requirement_confidence(evidence: Column) -> Column:
    return first_match(F.lower(F.coalesce(evidence, F.lit(""))), CONFIDENCES, 0.74)


def quality(title: Column, company: Column, description: Column, year: Column, skills: Column) -> Column:
    """Weighted presence of title, company, content, duties, skills and year; at most 1."""
    parts = (
        (0.22, F.trim(title) != ""), (0.10, F.trim(company) != ""), (0.18, F.length(description) >= 40), (0.10, F.length(description) >= 150),
        (0.12, description.rlike(DUTY_WORDS)), (0.14, skills > 0), (0.06, skills >= 3), (0.08, year.isNotNull()),
    )
    total = F.lit(0.0)
    for weight, holds in parts:
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return F.round(F.least(total, F.lit(1.0)), 6)


def staleness(year: Column, as_of: int) -> Column:
    # least and greatest pass over nulls, so an unknown year is told apart first.
    return F.when(year.isNull(), F.lit(1.0)).otherwise(F.round(F.least(F.greatest((F.lit(as_of) - year) / 8.0, F.lit(0.0)), F.lit(1.0)), 6))


def valid_year(year: Column, low: int = 2000, high: int = 2100) -> Column:
    return F.when(year.between(low, high), year)


def govern(postings: DataFrame, skill_counts: DataFrame | None = None, as_of: int = 2026, minimum: float = MINIMUM_QUALITY) -> DataFrame:
    """Canonical postings -> governed rows, without their duplicate groups.

    ``skill_counts`` (raw_id, skill_count, optionally stacks: the stacks of the skills found)
    joins on the key of the postings; without it no posting has skills. The most frequent of
    these stacks decides, words of the text only where there is none. Row failures cannot
    occur: every cast is tolerant.
    """
    p = spread(postings).select(
        "raw_id", "raw_title", standard_title(F.col("raw_title")).alias("title"), F.substring(spaces(F.col("company")), 1, 300).alias("company"),
        F.substring(spaces(F.col("city")), 1, 120).alias("city"), F.substring(spaces(F.col("experience")), 1, 200).alias("experience"),
        clean_description(F.col("description")).alias("description"), F.coalesce(valid_year(F.col("published_year")), F.year("published_at")).alias("year"),
        "salary_min", "salary_max", "published_at",
    )
    p = p.join(skill_counts.withColumnRenamed("raw_id", "__id"), F.col("raw_id") == F.col("__id"), "left").drop("__id") if skill_counts is not None else p.withColumn("skill_count", F.lit(0))
    p = p.withColumn("skill_count", F.coalesce("skill_count", F.lit(0)))
    stacks = F.coalesce("stacks", F.expr("cast(array() as array<string>)")) if "stacks" in p.columns else None
    both = F.concat(F.col("title"), F.lit("\n"), F.col("description"))
    scored = p.select(
        "*",
        infer_stack(both, stacks).alias("tech_stack"),
        infer_level(both, F.col("experience")).alias("level_name"),
        F.sha2(F.lower(spaces(both)), 256).alias("content_hash"),
        F.sha2(template_text(F.col("description")), 256).alias("template_hash"),
        quality(F.col("title"), F.col("company"), F.col("description"), F.col("year"), F.col("skill_count")).alias("quality_score"),
        staleness(F.col("year"), as_of).alias("stale_score"),
    )
    valid = (F.trim("title") != "") & (F.length("description") >= 20) & F.col("year").isNotNull() & (F.col("quality_score") >= minimum)
    return scored.withColumn("valid", valid.cast("int")).withColumn("status", F.when(F.col("valid") == 1, "CLEANED").otherwise("LOW_QUALITY"))


def issues(governed: DataFrame) -> DataFrame:
    """(raw_id, issue_type, field_name, severity): what a governed row lacks."""
    rules = (
        (F.trim("title") == "", "MISSING_FIELD", "title", "HIGH"), (F.length("description") < 20, "LOW_CONTENT", "description", "HIGH"),
        (F.col("year").isNull(), "MISSING_YEAR", "published_year", "HIGH"), (F.col("skill_count") == 0, "NO_SKILL", "skills", "MEDIUM"),
    )
    found = F.array(*[F.when(holds, F.struct(F.lit(t).alias("issue_type"), F.lit(f).alias("field_name"), F.lit(s).alias("severity"))) for holds, t, f, s in rules])
    return governed.select("raw_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("raw_id", "i.*")


def duplicate_clusters(rows: DataFrame, id_col: str, hash_col: str, valid: Column) -> DataFrame:
    """(template_hash, root_id, member_count) of templates with two or more valid rows."""
    return rows.where(valid & F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("template_hash")).agg(F.min(id_col).alias("root_id"), F.count(F.lit(1)).alias("member_count")).where("member_count > 1")


def duplicate_weight(members: Column) -> Column:
    return F.round(F.greatest(F.lit(0.15), 1 / F.sqrt(members)), 6)


def finish_duplicates(rows: DataFrame, id_col: str = "raw_job_id", hash_col: str = "template_hash") -> DataFrame:
    """Group, weight and status of every row that is not deleted.

    Clusters count valid rows; the group reaches every row with the template. Manual rows
    keep their status. Clusters come from a partial aggregation, so a template of any size
    is one row when it is joined back, and AQE splits the rows that meet it.
    """
    active = rows.where("is_deleted = 0")
    clusters = duplicate_clusters(active, id_col, hash_col, F.col("valid_for_analysis") == 1).withColumnRenamed("template_hash", "__h")
    joined = active.join(clusters, F.col(hash_col) == F.col("__h"), "left")
    status = F.when(F.col("manual_modified") == 1, F.col("governance_status")).when(F.col("member_count").isNotNull(), "DUPLICATE_REVIEW").when(F.col("valid_for_analysis") == 1, "CLEANED").otherwise("LOW_QUALITY")
    return joined.select(
        id_col,
        F.when(F.col("member_count").isNotNull(), F.concat(F.lit("TPL-"), F.col("root_id").cast("string"))).alias("new_group"),
        F.when(F.col("member_count").isNull(), F.lit(1.0)).otherwise(duplicate_weight(F.col("member_count"))).alias("new_weight"),
        status.alias("new_status"),
    )


def holdout_sample(raw: DataFrame, year: int, size: int, by: str = "crc32", seed: int = 20260101, id_col: str = "id", year_col: str = "posting_year") -> DataFrame:
    """(raw_id, holdout_year): ``size`` rows of a year in the order of a hash of id and seed, then id."""
    key = F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))
    order = F.crc32(key) if by == "crc32" else F.md5(key)
    return raw.where(F.col(year_col) == year).orderBy(order, id_col).limit(size).select(F.col(id_col).alias("raw_id"), F.lit(year).alias("holdout_year"))


def without_holdout(rows: DataFrame, holdout: DataFrame, id_col: str) -> DataFrame:
    held = holdout.select(F.col("raw_id").alias("__h"))
    return rows.join(held, F.col(id_col) == F.col("__h"), "left_anti")


def merge_jobs(old: DataFrame, new: DataFrame, key: str, refreshed: list[str]) -> DataFrame:
    """Upsert: new rows come in; of rows in both, manual and deleted ones keep ``refreshed`` columns as they are."""
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    protected = (F.col("o.manual_modified") == 1) | (F.col("o.is_deleted") == 1)
    keep = F.col(f"n.{key}").isNull() | F.coalesce(protected, F.lit(False))
    columns = [F.when(keep, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in refreshed]
    flags = [F.coalesce(f"o.{c}", F.lit(0)).alias(c) for c in ("manual_modified", "is_deleted")]
    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *columns, *flags)


def merge_skills(rows: DataFrame) -> DataFrame:
    """One row per posting and skill: a manual row wins, else the highest confidence; ties by the smallest id."""
    manual = F.upper(F.coalesce("origin_type", F.lit(""))) == "MANUAL"
    best = F.min(F.struct(F.when(manual, 0).otherwise(1).alias("m"), (-F.coalesce(double("confidence"), F.lit(0.0))).alias("c"), "id"))
    picked = rows.where("skill_name is not null").groupBy("raw_job_id", "skill_name").agg(best.alias("b"), F.count(F.lit(1)).alias("rows"))
    return picked.select("raw_job_id", "skill_name", F.col("b.id").alias("id"), (-F.col("b.c")).alias("confidence"), "rows")


def fold_edits(base: DataFrame, edits: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """``base`` with the newest stated value of each column out of append-only ``edits``; an edit that states nothing keeps the old value."""
    newest = edits.groupBy(F.col(key).alias("__k")).agg(*[F.max_by(F.col(c), F.struct(*[F.when(F.col(c).isNotNull(), F.col(o)) for o in order])).alias(f"__{c}") for c in columns], F.count(F.lit(1)).alias("edits"))
    joined = base.join(newest, F.col(key) == F.col("__k"), "left")
    return joined.select(key, *[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) for c in columns], F.coalesce("edits", F.lit(0)).alias("edits"))


def deduplicate_load(raw: DataFrame) -> DataFrame:
    """First row (smallest id) of each feed and content hash, as an idempotent load keeps it; rows without a hash are all kept."""
    keyed = F.coalesce(F.trim("content_hash"), F.lit("")) != ""
    w = Window.partitionBy("source_dataset", "content_hash").orderBy("id")
    first = raw.where(keyed).withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    return first.unionByName(raw.where(~keyed))


def content_key(title: Column, description: Column, company: Column) -> Column:
    return F.sha2(spaces(F.lower(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")), F.coalesce(company, F.lit(""))))), 256)
