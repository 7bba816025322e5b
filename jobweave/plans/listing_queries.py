"""Listing queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobweave.functions.measures import blank_null
from jobweave.operators import listings as L
from jobweave.plans.market_queries import EV, JOINED, OK, TITLED
from jobweave.plans.sql import all_blank_trim
from jobweave.sources.tables import table

QUERIES = {
    "graph_options": lambda s, d: L.graph_options(table(s, d, "governed")),
    "role_skills": lambda s, d: L.role_skills(table(s, d, "governed_skill"), table(s, d, "governed"), 2025),
    "last_events": lambda s, d: L.last_per_key(table(s, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").drop("ts"),
    "dominant_stacks": lambda s, d: L.dominant(table(s, d, "governed"), blank_null("title_standard"), "tech_stack"),
    "evidence_modes": lambda s, d: L.evidence_modes(table(s, d, "governed")),
    "pending_reviews": lambda s, d: L.pending(table(s, d, "governed"), table(s, d, "governed_skill")),
    "changed_skill_sets": lambda s, d: L.changed_sets(table(s, d, "governed_skill"), table(s, d, "governed"), 2024, 2025),
    "raw_columns": lambda s, d: table(s, d, "raw_job").agg(*[F.count(c).alias(c) for c in table(s, d, "raw_job").columns]),
}
_RAW = (
    "id source_dataset source_record_id posting_year posting_date title company city description education experience industry salary_min salary_max source_platform work_area "
    "work_location company_location job_count recruitment_category ai_keyword closing_date closing_year source_reference content_hash governance_status created_at"
).split()
SQL = {
    "graph_options": f"""SELECT 'stack' AS kind, value, rows, row_number() OVER (ORDER BY rows DESC, value) AS place FROM (SELECT coalesce(nullif(trim(tech_stack), ''), '未分类') AS value, count(*) AS rows FROM zhitu_governed_job WHERE {OK} AND {TITLED} GROUP BY 1 ORDER BY rows DESC, value LIMIT 40)
      UNION ALL SELECT 'level', value, rows, CASE value WHEN '初级' THEN 1 WHEN '中级' THEN 2 WHEN '高级' THEN 3 ELSE 4 END FROM (SELECT coalesce(nullif(trim(level_name), ''), '未标注') AS value, count(*) AS rows FROM zhitu_governed_job WHERE {OK} AND {TITLED} GROUP BY 1)""",
    "role_skills": f"""WITH p AS (SELECT trim(title_standard) AS role, skill_name, round(sum(CASE WHEN kind = 'REQUIRED' THEN support ELSE 0 END), 6) AS r, round(sum(CASE WHEN kind IN ('BONUS', 'PREFERRED') THEN support ELSE 0 END), 6) AS b,
      round(sum(CASE WHEN kind NOT IN ('BONUS', 'PREFERRED') THEN support ELSE 0 END), 6) AS u FROM {JOINED} WHERE {TITLED} AND published_year = 2025 GROUP BY 1, 2),
      e AS (SELECT *, r > 0 OR (sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY role) < 5 AND u > 0) AS eligible FROM p),
      k AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY eligible DESC, (r > 0) DESC, r DESC, u DESC, skill_name) AS place FROM e)
      SELECT role, 'required' AS part, skill_name, place FROM k WHERE eligible AND place <= 8 UNION ALL
      SELECT role, 'bonus', skill_name, p2 FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY b DESC, skill_name) AS p2 FROM k WHERE NOT (eligible AND place <= 8) AND b > 0) WHERE p2 <= 6""",
    "last_events": """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY back DESC) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 6""",
    "dominant_stacks": "SELECT key, arg_min(value, (-n, value)) AS value, max(n) AS rows, count(*) AS values FROM (SELECT nullif(trim(title_standard), '') AS key, nullif(trim(tech_stack), '') AS value, count(*) AS n FROM zhitu_governed_job GROUP BY 1, 2) WHERE key IS NOT NULL AND value IS NOT NULL GROUP BY 1",
    "evidence_modes": f"SELECT published_year, count(*) AS rows, count(DISTINCT {EV}) AS distinct_evidence, round(sum(CAST(duplicate_weight AS DOUBLE)), 3) AS weighted FROM zhitu_governed_job WHERE {OK} GROUP BY 1",
    "pending_reviews": """SELECT 'posting' AS kind, raw_job_id AS id, title_standard, NULL AS skill_name, round(1 - coalesce(CAST(quality_score AS DOUBLE), 0), 6) AS risk FROM zhitu_governed_job WHERE is_deleted = 0 AND governance_status = 'DUPLICATE_REVIEW'
      UNION ALL SELECT 'relation', id, NULL, skill_name, round(1 - CAST(confidence AS DOUBLE), 6) FROM zhitu_governed_job_skill WHERE CAST(confidence AS DOUBLE) < 0.75""",
    "changed_skill_sets": f"""WITH s AS (SELECT trim(title_standard) AS role, list_distinct(list(skill_name) FILTER (published_year = 2024)) AS a, list_distinct(list(skill_name) FILTER (published_year = 2025)) AS b FROM {JOINED} WHERE {TITLED} AND published_year IN (2024, 2025) GROUP BY 1),
      n AS (SELECT role, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS k FROM s WHERE len(a) > 0 AND len(b) > 0) SELECT role, nb - k AS added, na - k AS dropped, k AS kept, round(k / (na + nb - k), 6) AS similarity FROM n""",
    "raw_columns": "SELECT " + ", ".join(f"count({c}) AS {c}" for c in _RAW) + " FROM dataset_job_raw",
}
SQL = all_blank_trim(SQL)
