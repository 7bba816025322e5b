"""Market analyses over governed postings and their skills.

Every builder takes the governed table (and the skill relation where it needs one) and
returns a DataFrame; filters and column choice reach the Parquet scan. Top-k builders end
with a total order, so that ties cannot change the result. ``REGISTRY`` is the whole query
language: a plan names a builder and bounded parameters, never SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions.measures import analysable, blank_null, distinct_filled, double, evidence, filled, first_half

BONUS_TYPES = ("BONUS", "PREFERRED")


def _mid_salary() -> Column:
    return F.nullif((double("salary_min") + double("salary_max")) / 2, F.lit(0.0))


def job_filter(year: int | None = None, start: int | None = None, end: int | None = None, role: str | None = None, city: str | None = None) -> Column:
    """Analysable postings of the stated years whose title and city contain the stated words, case ignored."""
    where = analysable()
    if year is not None:
        where &= F.col("published_year") == year
    if start is not None:
        where &= F.col("published_year") >= start
    if end is not None:
        where &= F.col("published_year") <= end
    for column, word in (("title_standard", role), ("city", city)):
        if word and word.strip():
            where &= F.contains(F.lower(column), F.lit(word.strip().lower()))
    return where


def titled() -> Column:
    return blank_null("title_standard").isNotNull()


def _top(df: DataFrame, k: int | None, *order: Column) -> DataFrame:
    return df if k is None else df.orderBy(*order).limit(k)


def _title_measures() -> list[Column]:
    return [
        evidence().alias("job_count"),
        distinct_filled("company").alias("company_count"),
        evidence(first_half()).alias("h1_count"),
        evidence(F.month("published_at") > 6).alias("h2_count"),
        F.round(F.avg(double("quality_score")), 6).alias("avg_quality"),
        F.round(F.avg(_mid_salary()), 4).alias("avg_salary"),
    ]


def top_roles(jobs: DataFrame, k: int | None = 10, **filters) -> DataFrame:
    rows = jobs.where(job_filter(**filters) & titled()).groupBy("title_standard").agg(*_title_measures())
    return _top(rows, k, F.desc("job_count"), F.asc("title_standard"))


def role_trend(jobs: DataFrame, start: int, end: int, role: str | None = None) -> DataFrame:
    rows = jobs.where(job_filter(start=start, end=end, role=role) & titled())
    return rows.groupBy("published_year").agg(*_title_measures(), F.countDistinct("title_standard").alias("role_count"))


def with_jobs(skills: DataFrame, jobs: DataFrame, where: Column, *columns: str) -> DataFrame:
    """Skill relation joined with the analysable postings it belongs to; both sides are pruned before the join."""
    kept = jobs.where(where).select("raw_job_id", "duplicate_group", "duplicate_weight", *columns)
    relation = skills.where(blank_null("skill_name").isNotNull()).select(
        "raw_job_id", "skill_name", F.col("tech_stack").alias("skill_stack"), "category", F.upper(F.coalesce("requirement_type", F.lit(""))).alias("kind"), "confidence"
    )
    return relation.join(kept, "raw_job_id").withColumn("support", F.coalesce(double("duplicate_weight"), F.lit(1.0)) * F.coalesce(double("confidence"), F.lit(0.0)))


def top_skills(skills: DataFrame, jobs: DataFrame, k: int | None = 20, **filters) -> DataFrame:
    rows = with_jobs(skills, jobs, job_filter(**filters)).groupBy("skill_name").agg(
        evidence().alias("job_count"),
        F.count_if(F.col("kind") == "REQUIRED").alias("required_mentions"),
        F.count_if(F.col("kind").isin(*BONUS_TYPES)).alias("bonus_mentions"),
        F.round(F.sum("support"), 4).alias("support_weight"),
    )
    return _top(rows, k, F.desc("job_count"), F.asc("skill_name"))


def dimension_ranking(jobs: DataFrame, dimension: str, k: int | None = 10, **filters) -> DataFrame:
    """Postings, companies and pay per value of one column; blank values are left out."""
    rows = jobs.where(job_filter(**filters)).withColumn("value", blank_null(dimension)).where("value is not null")
    ranked = rows.groupBy("value").agg(
        evidence().alias("job_count"), distinct_filled("company").alias("company_count"), F.round(F.avg(_mid_salary()), 4).alias("avg_salary")
    )
    return _top(ranked, k, F.desc("job_count"), F.asc("value"))


def market_summary(jobs: DataFrame, **filters) -> DataFrame:
    return jobs.where(job_filter(**filters)).agg(
        evidence().alias("job_count"),
        F.countDistinct(blank_null("title_standard")).alias("role_count"),
        distinct_filled("company").alias("company_count"),
        distinct_filled("city").alias("city_count"),
        distinct_filled("source_name").alias("source_count"),
        F.min("published_year").alias("first_year"),
        F.max("published_year").alias("last_year"),
        F.round(F.avg(double("quality_score")), 6).alias("avg_quality"),
    )


def salary_summary(jobs: DataFrame, **filters) -> DataFrame:
    paid = jobs.where(job_filter(**filters) & F.col("salary_min").isNotNull() & F.col("salary_max").isNotNull())
    return paid.agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.round(F.avg(double("salary_min")), 4).alias("avg_min"),
        F.round(F.avg(double("salary_max")), 4).alias("avg_max"),
        F.min(double("salary_min")).alias("lowest"),
        F.max(double("salary_max")).alias("highest"),
    )


def quality_summary(jobs: DataFrame) -> DataFrame:
    return jobs.where("is_deleted = 0").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("valid_for_analysis") == 1).alias("valid_rows"),
        F.count_if(F.col("governance_status") == "LOW_QUALITY").alias("low_quality"),
        F.count_if(F.col("governance_status") == "DUPLICATE_REVIEW").alias("duplicates"),
        F.count_if(F.col("manual_modified") == 1).alias("manual_rows"),
        F.round(F.avg(double("quality_score")), 6).alias("avg_quality"),
        F.round(F.avg(double("stale_score")), 6).alias("avg_stale"),
        F.round(F.sum(double("duplicate_weight")), 3).alias("effective_rows"),
    )


def stack_year_cube(jobs: DataFrame) -> DataFrame:
    """Postings per technology stack and year with both marginals and the total, in one pass."""
    rows = jobs.where(analysable()).select(filled("tech_stack", "未分类").alias("stack"), F.col("published_year").alias("year"))
    counted = rows.groupBy("stack", "year").agg(F.count(F.lit(1)).alias("n"))  # small before it is expanded
    return counted.cube("stack", "year").agg(F.sum("n").alias("job_count"), F.grouping("stack").alias("all_stacks"), F.grouping("year").alias("all_years"))


def skill_totals(skills: DataFrame, jobs: DataFrame) -> DataFrame:
    """Relations and different skills, totals over the ranking of skills."""
    per = with_jobs(skills, jobs, analysable()).groupBy("skill_name").agg(F.count(F.lit(1)).alias("n"), F.sum("support").alias("s"))
    return per.agg(F.sum("n").alias("relations"), F.count(F.lit(1)).alias("skills"), F.max("n").alias("largest"), F.round(F.sum("s"), 3).alias("support"))


def latest_years(jobs: DataFrame, k: int = 2, low: int = 2000, high: int = 2100) -> DataFrame:
    rows = jobs.where(analysable() & F.col("published_year").between(low, high)).groupBy("published_year").agg(F.count(F.lit(1)).alias("rows"))
    return rows.orderBy(F.desc("published_year")).limit(k)


def year_stats(raw: DataFrame, jobs: DataFrame, holdout: DataFrame) -> DataFrame:
    """Per raw year: rows, rows held out, rows left for training, governed and valid rows."""
    held = holdout.select(F.col("raw_id").alias("h_id")).distinct()
    base = raw.select("id", F.col("posting_year").alias("year")).join(held, F.col("id") == F.col("h_id"), "left")
    per_raw = base.groupBy("year").agg(F.count(F.lit(1)).alias("total"), F.count("h_id").alias("held_out"))
    per_governed = jobs.where("is_deleted = 0").groupBy(F.col("published_year").alias("g_year")).agg(
        F.count(F.lit(1)).alias("governed"), F.count_if(F.col("valid_for_analysis") == 1).alias("valid")
    )
    joined = per_raw.where("year is not null").join(per_governed, F.col("year") == F.col("g_year"), "left")
    return joined.select("year", "total", "held_out", (F.col("total") - F.col("held_out")).alias("train"), F.coalesce("governed", F.lit(0)).alias("governed"), F.coalesce("valid", F.lit(0)).alias("valid"))


STATES: dict[str, Callable[[], Column]] = {
    "ALL": lambda: F.lit(True),
    "ACTIVE": lambda: F.col("is_deleted") == 0,
    "VALID": lambda: analysable(),
    "LOW_QUALITY": lambda: (F.col("is_deleted") == 0) & (F.col("valid_for_analysis") == 0),
    "MANUAL": lambda: (F.col("is_deleted") == 0) & (F.col("manual_modified") == 1),
    "DELETED": lambda: F.col("is_deleted") == 1,
}
KEYWORD_COLUMNS = ("title_standard", "title_raw", "company", "city", "tech_stack")


def listing_filter(state: str = "ACTIVE", year: int | None = None, keyword: str | None = None) -> Column:
    where = STATES[state]()
    if year is not None:
        where &= F.col("published_year") == year
    if keyword and keyword.strip():
        any_column = F.lit(False)
        for c in KEYWORD_COLUMNS:
            any_column |= F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(keyword.strip().lower()))
        where &= any_column
    return where


def page(jobs: DataFrame, number: int = 1, size: int = 20, **filters) -> DataFrame:
    """One page, newest ids first, with the total number of rows and pages."""
    size, number = max(10, min(100, size)), max(1, number)
    rows = jobs.where(listing_filter(**filters)).select("raw_job_id", "title_standard", "company", "city", "published_year", "quality_score")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    shown = rows.orderBy(F.desc("raw_job_id")).offset((number - 1) * size).limit(size)
    return shown.crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size))  # one row


def state_counts(jobs: DataFrame) -> DataFrame:
    """Rows in each listing state, one pass."""
    counts = jobs.agg(*[F.count_if(F.coalesce(STATES[s](), F.lit(False))).alias(s) for s in STATES])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).alias("rows")) for s in STATES])).alias("x")).select("x.*")


def ordered_skills(skills: DataFrame) -> DataFrame:
    """Skills of each posting with their place: required, then preferred, then the rest; by confidence, name, id."""
    kind = F.upper(F.coalesce("requirement_type", F.lit("")))
    order = F.when(kind == "REQUIRED", 1).when(kind.isin(*BONUS_TYPES), 2).otherwise(3)
    w = Window.partitionBy("raw_job_id").orderBy(order, F.desc_nulls_last("confidence"), F.asc_nulls_first("skill_name"), "id")
    return skills.where("skill_name is not null").select("id", "raw_job_id", "skill_name", F.row_number().over(w).alias("place"))


def recent_window(skills: DataFrame, jobs: DataFrame, terms: tuple[str, ...], window: int = 500, k: int = 8) -> DataFrame:
    """The newest ``window`` analysable postings that mention a term, the first ``k``, with their skills in one string."""
    recent = jobs.where(analysable()).orderBy(F.desc("raw_job_id")).limit(window)
    text = F.lower(F.concat_ws(" ", "title_standard", "title_raw", "company", "city", "tech_stack", "description_clean"))
    hit = F.lit(False)
    for t in terms:
        hit |= F.contains(text, F.lit(t.lower()))
    chosen = recent.where(hit).orderBy(F.desc("quality_score"), F.desc("raw_job_id")).limit(k).select("raw_job_id", "title_standard", "company")
    per = skills.join(F.broadcast(chosen.select("raw_job_id")), "raw_job_id", "left_semi").where("skill_name is not null")  # at most k rows
    named = per.groupBy("raw_job_id", "skill_name").agg(F.max(F.coalesce("confidence", F.lit(0))).alias("c"))
    listed = named.groupBy("raw_job_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("o"), "skill_name"))).alias("l"))
    return chosen.join(listed, "raw_job_id", "left").select("raw_job_id", "title_standard", "company", F.coalesce(F.array_join("l.skill_name", ","), F.lit("")).alias("skills"))


def scenario_ranking(jobs: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most frequent industries of each role."""
    rows = jobs.where(analysable() & titled()).select("title_standard", blank_null("industry").alias("industry")).where("industry is not null")
    counted = rows.groupBy("title_standard", "industry").agg(F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy("title_standard").orderBy(F.desc("rows"), F.asc("industry"))
    return counted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def overview(raw: DataFrame, jobs: DataFrame, skills: DataFrame) -> DataFrame:
    """Ten counters of the whole collection, each table read once."""
    r = raw.agg(F.count(F.lit(1)).alias("raw_rows"), F.count("posting_year").alias("dated_rows"), F.countDistinct("source_dataset").alias("feeds"))
    g = jobs.agg(
        F.count(F.lit(1)).alias("governed_rows"),
        F.count_if(analysable()).alias("valid_rows"),
        F.count_if(F.col("is_deleted") == 1).alias("deleted_rows"),
        F.count_if(F.col("governance_status") == "DUPLICATE_REVIEW").alias("review_rows"),
        F.max("raw_job_id").alias("last_id"),
    )
    s = skills.agg(F.count(F.lit(1)).alias("relations"), F.countDistinct("skill_name").alias("skills"))
    return r.crossJoin(g).crossJoin(s)  # one row each


def job_samples(jobs: DataFrame, k: int = 10, **filters) -> DataFrame:
    rows = jobs.where(job_filter(**filters)).select("raw_job_id", "title_standard", "company", "city", F.substring("description_clean", 1, 120).alias("excerpt"), double("quality_score").alias("quality"))
    return rows.orderBy(F.desc_nulls_last("quality"), F.asc("raw_job_id")).limit(k)


def id_batches(jobs: DataFrame, span: int = 10_000) -> DataFrame:
    """Rows and weights per range of ids, as a keyset scan would meet them."""
    return jobs.groupBy(F.floor((F.col("raw_job_id") - 1) / span).alias("batch")).agg(
        F.min("raw_job_id").alias("first_id"), F.max("raw_job_id").alias("last_id"), F.count(F.lit(1)).alias("rows"), F.round(F.sum(double("duplicate_weight")), 3).alias("weight")
    )


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


@dataclass(frozen=True)
class QueryPlan:
    """A bounded query: its kind and parameters, already within their limits."""

    kind: str
    year: int | None = None
    start: int | None = None
    end: int | None = None
    role: str | None = None
    city: str | None = None
    limit: int = 10

    def filters(self) -> dict:
        return {k: v for k, v in (("year", self.year), ("start", self.start), ("end", self.end), ("role", self.role), ("city", self.city)) if v is not None}


REGISTRY: dict[str, Callable[[QueryPlan, DataFrame, DataFrame], DataFrame]] = {
    "TOP_ROLES": lambda p, jobs, skills: top_roles(jobs, p.limit, **p.filters()),
    "ROLE_TREND": lambda p, jobs, skills: role_trend(jobs, p.start or 2000, p.end or 2100, p.role),
    "TOP_SKILLS": lambda p, jobs, skills: top_skills(skills, jobs, p.limit, **p.filters()),
    "TOP_CITIES": lambda p, jobs, skills: dimension_ranking(jobs, "city", p.limit, **p.filters()),
    "TOP_COMPANIES": lambda p, jobs, skills: dimension_ranking(jobs, "company", p.limit, **p.filters()),
    "TOP_INDUSTRIES": lambda p, jobs, skills: dimension_ranking(jobs, "industry", p.limit, **p.filters()),
    "EDUCATION": lambda p, jobs, skills: dimension_ranking(jobs, "education", p.limit, **p.filters()),
    "TECH_STACK": lambda p, jobs, skills: dimension_ranking(jobs, "tech_stack", p.limit, **p.filters()),
    "LEVEL": lambda p, jobs, skills: dimension_ranking(jobs, "level_name", p.limit, **p.filters()),
    "MARKET_SUMMARY": lambda p, jobs, skills: market_summary(jobs, **p.filters()),
    "SALARY_SUMMARY": lambda p, jobs, skills: salary_summary(jobs, **p.filters()),
    "QUALITY_SUMMARY": lambda p, jobs, skills: quality_summary(jobs),
    "JOB_SAMPLES": lambda p, jobs, skills: job_samples(jobs, p.limit, **p.filters()),
    "INDUSTRY_SCENARIOS": lambda p, jobs, skills: scenario_ranking(jobs, p.limit),
    "SKILL_TOTALS": lambda p, jobs, skills: skill_totals(skills, jobs),
    "LATEST_YEARS": lambda p, jobs, skills: latest_years(jobs, p.limit),
}


def run_plan(plan: QueryPlan, jobs: DataFrame, skills: DataFrame) -> DataFrame:
    return REGISTRY[plan.kind](plan, jobs, skills)
