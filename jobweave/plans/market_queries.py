"""Market queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.operators import market as M
from jobweave.operators.governance import holdout_sample
from jobweave.plans.sql import all_blank_trim
from jobweave.sources.tables import table

YEAR = 2025


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "governed")


def _skills(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "governed_skill")


def _holdout_by_md5(raw: DataFrame, year: int, size: int) -> DataFrame:
    return holdout_sample(raw, year, size, "md5")


QUERIES = {
    "top_roles": lambda s, d: M.top_roles(_jobs(s, d), 10, year=YEAR),
    "top_roles_by_keyword": lambda s, d: M.top_roles(_jobs(s, d), 10, role="工程师", start=2023, end=2025),
    "role_titles": lambda s, d: M.top_roles(_jobs(s, d), None),
    "role_trend": lambda s, d: M.role_trend(_jobs(s, d), 2019, 2026),
    "role_trend_by_keyword": lambda s, d: M.role_trend(_jobs(s, d), 2019, 2026, "engineer"),
    "top_skills": lambda s, d: M.top_skills(_skills(s, d), _jobs(s, d), 20),
    "skill_ranking": lambda s, d: M.top_skills(_skills(s, d), _jobs(s, d), None),
    "skill_totals": lambda s, d: M.skill_totals(_skills(s, d), _jobs(s, d)),
    "top_cities": lambda s, d: M.dimension_ranking(_jobs(s, d), "city"),
    "top_companies": lambda s, d: M.dimension_ranking(_jobs(s, d), "company"),
    "industry_ranking": lambda s, d: M.dimension_ranking(_jobs(s, d), "industry"),
    "education_ranking": lambda s, d: M.dimension_ranking(_jobs(s, d), "education", None),
    "stack_ranking": lambda s, d: M.dimension_ranking(_jobs(s, d), "tech_stack", None),
    "level_ranking": lambda s, d: M.dimension_ranking(_jobs(s, d), "level_name", None),
    "market_summary": lambda s, d: M.market_summary(_jobs(s, d), start=2020, end=2026),
    "salary_summary": lambda s, d: M.salary_summary(_jobs(s, d)),
    "quality_summary": lambda s, d: M.quality_summary(_jobs(s, d)),
    "stack_year_cube": lambda s, d: M.stack_year_cube(_jobs(s, d)),
    "latest_years": lambda s, d: M.latest_years(_jobs(s, d)),
    "year_stats": lambda s, d: M.year_stats(table(s, d, "raw_job"), _jobs(s, d), _holdout_by_md5(table(s, d, "raw_job"), 2026, 100)),
    "listing_states": lambda s, d: M.state_counts(_jobs(s, d)),
    "listing_page": lambda s, d: M.page(_jobs(s, d), 2, 20, state="VALID", keyword="平台"),
    "ordered_skills": lambda s, d: M.ordered_skills(_skills(s, d)),
    "recent_evidence": lambda s, d: M.recent_window(_skills(s, d), _jobs(s, d), ("平台", "platform")),
    "industry_scenarios": lambda s, d: M.scenario_ranking(_jobs(s, d)),
    "overview": lambda s, d: M.overview(table(s, d, "raw_job"), _jobs(s, d), _skills(s, d)),
    "job_samples": lambda s, d: M.job_samples(_jobs(s, d), 10, year=YEAR),
    "id_batches": lambda s, d: M.id_batches(_jobs(s, d)),
    "newest_per_source": lambda s, d: M.latest_per_key(_jobs(s, d).select("source_name", "raw_job_id", "governed_at"), ["source_name"], F.desc_nulls_last("governed_at"), F.desc("raw_job_id")),
}

OK = "valid_for_analysis = 1 AND is_deleted = 0"
EV = "COALESCE(NULLIF(TRIM(duplicate_group), ''), 'U-' || CAST(raw_job_id AS VARCHAR))"
TITLED = "NULLIF(TRIM(title_standard), '') IS NOT NULL"
MID = "NULLIF((CAST(salary_min AS DOUBLE) + CAST(salary_max AS DOUBLE)) / 2, 0)"
TITLE_MEASURES = f"""
  count(DISTINCT {EV}) AS job_count, count(DISTINCT NULLIF(TRIM(company), '')) AS company_count,
  count(DISTINCT CASE WHEN month(published_at) <= 6 THEN {EV} END) AS h1_count,
  count(DISTINCT CASE WHEN month(published_at) > 6 THEN {EV} END) AS h2_count,
  round(avg(CAST(quality_score AS DOUBLE)), 6) AS avg_quality, round(avg({MID}), 4) AS avg_salary"""
JOINED = f"""(SELECT s.id, s.raw_job_id, s.skill_name, s.tech_stack AS skill_stack, s.category, upper(coalesce(s.requirement_type, '')) AS kind,
  coalesce(CAST(s.confidence AS DOUBLE), 0) AS confidence, g.duplicate_group, g.title_standard, g.tech_stack, g.level_name, g.published_year, g.quality_score,
  coalesce(CAST(g.duplicate_weight AS DOUBLE), 1) * coalesce(CAST(s.confidence AS DOUBLE), 0) AS support
  FROM zhitu_governed_job_skill s JOIN zhitu_governed_job g USING (raw_job_id) WHERE {OK} AND NULLIF(TRIM(s.skill_name), '') IS NOT NULL)"""
_SKILLS = f"""SELECT skill_name, count(DISTINCT {EV}) AS job_count, count(*) FILTER (kind = 'REQUIRED') AS required_mentions,
  count(*) FILTER (kind IN ('BONUS', 'PREFERRED')) AS bonus_mentions, round(sum(support), 4) AS support_weight FROM {JOINED} GROUP BY skill_name"""


def _dimension(column: str, k: int | None = 10) -> str:
    tail = f" ORDER BY job_count DESC, value LIMIT {k}" if k else ""
    return f"""SELECT NULLIF(TRIM({column}), '') AS value, count(DISTINCT {EV}) AS job_count, count(DISTINCT NULLIF(TRIM(company), '')) AS company_count,
      round(avg({MID}), 4) AS avg_salary FROM zhitu_governed_job WHERE {OK} AND NULLIF(TRIM({column}), '') IS NOT NULL GROUP BY 1{tail}"""


_ROLES = f"SELECT title_standard, {TITLE_MEASURES} FROM zhitu_governed_job WHERE {OK} AND {TITLED}"
_KEYWORDS = " OR ".join(f"contains(lower(coalesce({c}, '')), '平台')" for c in M.KEYWORD_COLUMNS)
SQL = {
    "top_roles": f"{_ROLES} AND published_year = {YEAR} GROUP BY 1 ORDER BY job_count DESC, title_standard LIMIT 10",
    "top_roles_by_keyword": f"{_ROLES} AND published_year BETWEEN 2023 AND 2025 AND contains(lower(title_standard), '工程师') GROUP BY 1 ORDER BY job_count DESC, title_standard LIMIT 10",
    "role_titles": f"{_ROLES} GROUP BY 1",
    "role_trend": f"SELECT published_year, {TITLE_MEASURES}, count(DISTINCT title_standard) AS role_count FROM zhitu_governed_job WHERE {OK} AND {TITLED} AND published_year BETWEEN 2019 AND 2026 GROUP BY 1",
    "role_trend_by_keyword": f"SELECT published_year, {TITLE_MEASURES}, count(DISTINCT title_standard) AS role_count FROM zhitu_governed_job WHERE {OK} AND {TITLED} AND published_year BETWEEN 2019 AND 2026 AND contains(lower(title_standard), 'engineer') GROUP BY 1",
    "top_skills": f"{_SKILLS} ORDER BY job_count DESC, skill_name LIMIT 20",
    "skill_ranking": _SKILLS,
    "skill_totals": f"SELECT sum(n)::BIGINT AS relations, count(*) AS skills, max(n) AS largest, round(sum(s), 3) AS support FROM (SELECT count(*) AS n, sum(support) AS s FROM {JOINED} GROUP BY skill_name)",
    "top_cities": _dimension("city"),
    "top_companies": _dimension("company"),
    "industry_ranking": _dimension("industry"),
    "education_ranking": _dimension("education", None),
    "stack_ranking": _dimension("tech_stack", None),
    "level_ranking": _dimension("level_name", None),
    "market_summary": f"""SELECT count(DISTINCT {EV}) AS job_count, count(DISTINCT NULLIF(TRIM(title_standard), '')) AS role_count, count(DISTINCT NULLIF(TRIM(company), '')) AS company_count,
      count(DISTINCT NULLIF(TRIM(city), '')) AS city_count, count(DISTINCT NULLIF(TRIM(source_name), '')) AS source_count, min(published_year) AS first_year, max(published_year) AS last_year,
      round(avg(CAST(quality_score AS DOUBLE)), 6) AS avg_quality FROM zhitu_governed_job WHERE {OK} AND published_year BETWEEN 2020 AND 2026""",
    "salary_summary": f"""SELECT count(*) AS sample_count, round(avg(CAST(salary_min AS DOUBLE)), 4) AS avg_min, round(avg(CAST(salary_max AS DOUBLE)), 4) AS avg_max,
      min(CAST(salary_min AS DOUBLE)) AS lowest, max(CAST(salary_max AS DOUBLE)) AS highest FROM zhitu_governed_job WHERE {OK} AND salary_min IS NOT NULL AND salary_max IS NOT NULL""",
    "quality_summary": """SELECT count(*) AS rows, count(*) FILTER (valid_for_analysis = 1) AS valid_rows, count(*) FILTER (governance_status = 'LOW_QUALITY') AS low_quality,
      count(*) FILTER (governance_status = 'DUPLICATE_REVIEW') AS duplicates, count(*) FILTER (manual_modified = 1) AS manual_rows, round(avg(CAST(quality_score AS DOUBLE)), 6) AS avg_quality,
      round(avg(CAST(stale_score AS DOUBLE)), 6) AS avg_stale, round(sum(CAST(duplicate_weight AS DOUBLE)), 3) AS effective_rows FROM zhitu_governed_job WHERE is_deleted = 0""",
    "stack_year_cube": f"""SELECT stack, year, count(*) AS job_count, CAST(grouping(stack) AS TINYINT) AS all_stacks, CAST(grouping(year) AS TINYINT) AS all_years
      FROM (SELECT coalesce(NULLIF(TRIM(tech_stack), ''), '未分类') AS stack, published_year AS year FROM zhitu_governed_job WHERE {OK}) GROUP BY CUBE (stack, year)""",
    "latest_years": f"SELECT published_year, count(*) AS rows FROM zhitu_governed_job WHERE {OK} AND published_year BETWEEN 2000 AND 2100 GROUP BY 1 ORDER BY 1 DESC LIMIT 2",
    "year_stats": """WITH h AS (SELECT id FROM dataset_job_raw WHERE posting_year = 2026 ORDER BY md5(CAST(id AS VARCHAR) || ':20260101'), id LIMIT 100)
      SELECT r.year, r.total, r.held_out, r.total - r.held_out AS train, coalesce(g.governed, 0) AS governed, coalesce(g.valid, 0) AS valid
      FROM (SELECT posting_year AS year, count(*) AS total, count(h.id) AS held_out FROM dataset_job_raw d LEFT JOIN h ON d.id = h.id WHERE posting_year IS NOT NULL GROUP BY 1) r
      LEFT JOIN (SELECT published_year AS year, count(*) AS governed, count(*) FILTER (valid_for_analysis = 1) AS valid FROM zhitu_governed_job WHERE is_deleted = 0 GROUP BY 1) g ON r.year = g.year""",
    "listing_states": f"""SELECT 'ALL' AS state, count(*) AS rows FROM zhitu_governed_job UNION ALL SELECT 'ACTIVE', count(*) FROM zhitu_governed_job WHERE is_deleted = 0
      UNION ALL SELECT 'VALID', count(*) FROM zhitu_governed_job WHERE {OK} UNION ALL SELECT 'LOW_QUALITY', count(*) FROM zhitu_governed_job WHERE is_deleted = 0 AND valid_for_analysis = 0
      UNION ALL SELECT 'MANUAL', count(*) FROM zhitu_governed_job WHERE is_deleted = 0 AND manual_modified = 1 UNION ALL SELECT 'DELETED', count(*) FROM zhitu_governed_job WHERE is_deleted = 1""",
    "listing_page": f"""WITH r AS (SELECT raw_job_id, title_standard, company, city, published_year, quality_score FROM zhitu_governed_job WHERE {OK} AND ({_KEYWORDS}))
      SELECT p.*, t.total, CAST(ceil(t.total / 20.0) AS BIGINT) AS pages FROM (SELECT * FROM r ORDER BY raw_job_id DESC LIMIT 20 OFFSET 20) p, (SELECT count(*) AS total FROM r) t""",
    "ordered_skills": """SELECT id, raw_job_id, skill_name, row_number() OVER (PARTITION BY raw_job_id ORDER BY CASE WHEN upper(coalesce(requirement_type, '')) = 'REQUIRED' THEN 1
      WHEN upper(coalesce(requirement_type, '')) IN ('BONUS', 'PREFERRED') THEN 2 ELSE 3 END, confidence DESC NULLS LAST, skill_name NULLS FIRST, id) AS place FROM zhitu_governed_job_skill WHERE skill_name IS NOT NULL""",
    "recent_evidence": f"""WITH r AS (SELECT * FROM zhitu_governed_job WHERE {OK} ORDER BY raw_job_id DESC LIMIT 500),
      c AS (SELECT raw_job_id, title_standard, company FROM r WHERE regexp_matches(lower(concat_ws(' ', title_standard, title_raw, company, city, tech_stack, description_clean)), '平台|platform') ORDER BY quality_score DESC NULLS LAST, raw_job_id DESC LIMIT 8),
      n AS (SELECT raw_job_id, skill_name, max(coalesce(confidence, 0)) AS c FROM zhitu_governed_job_skill WHERE skill_name IS NOT NULL GROUP BY 1, 2)
      SELECT c.raw_job_id, c.title_standard, c.company, coalesce(string_agg(n.skill_name, ',' ORDER BY n.c DESC, n.skill_name), '') AS skills FROM c LEFT JOIN n ON c.raw_job_id = n.raw_job_id GROUP BY 1, 2, 3""",
    "industry_scenarios": f"""SELECT * FROM (SELECT title_standard, industry, rows, row_number() OVER (PARTITION BY title_standard ORDER BY rows DESC, industry) AS place FROM
      (SELECT title_standard, NULLIF(TRIM(industry), '') AS industry, count(*) AS rows FROM zhitu_governed_job WHERE {OK} AND {TITLED} AND NULLIF(TRIM(industry), '') IS NOT NULL GROUP BY 1, 2)) WHERE place <= 3""",
    "overview": f"""SELECT * FROM (SELECT count(*) AS raw_rows, count(posting_year) AS dated_rows, count(DISTINCT source_dataset) AS feeds FROM dataset_job_raw),
      (SELECT count(*) AS governed_rows, count(*) FILTER ({OK}) AS valid_rows, count(*) FILTER (is_deleted = 1) AS deleted_rows, count(*) FILTER (governance_status = 'DUPLICATE_REVIEW') AS review_rows, max(raw_job_id) AS last_id FROM zhitu_governed_job),
      (SELECT count(*) AS relations, count(DISTINCT skill_name) AS skills FROM zhitu_governed_job_skill)""",
    "job_samples": f"""SELECT raw_job_id, title_standard, company, city, substring(description_clean, 1, 120) AS excerpt, CAST(quality_score AS DOUBLE) AS quality FROM zhitu_governed_job
      WHERE {OK} AND published_year = {YEAR} ORDER BY quality DESC NULLS LAST, raw_job_id LIMIT 10""",
    "id_batches": "SELECT CAST(floor((raw_job_id - 1) / 10000.0) AS BIGINT) AS batch, min(raw_job_id) AS first_id, max(raw_job_id) AS last_id, count(*) AS rows, round(sum(CAST(duplicate_weight AS DOUBLE)), 3) AS weight FROM zhitu_governed_job GROUP BY 1",
    "newest_per_source": "SELECT source_name, raw_job_id, governed_at FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY governed_at DESC NULLS LAST, raw_job_id DESC) AS k FROM zhitu_governed_job) WHERE k = 1",
}

SQL = all_blank_trim(SQL)
