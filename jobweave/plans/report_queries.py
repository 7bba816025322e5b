"""Report queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.operators import evolution as E
from jobweave.operators import forecast as P
from jobweave.operators import governance as G
from jobweave.operators import listings as L
from jobweave.operators import matching as M
from jobweave.operators import reports as R
from jobweave.operators.resume import SIGNS, resume_likeness
from jobweave.plans.analysis_queries import SQL as ANALYSES
from jobweave.plans.analysis_queries import YEARS
from jobweave.plans.governance_queries import SQL as GOVERNANCE
from jobweave.plans.governance_queries import _governed
from jobweave.plans.listing_queries import SQL as LISTINGS
from jobweave.plans.market_queries import OK, TITLED
from jobweave.plans.people_queries import _NEEDS as NEEDS
from jobweave.plans.people_queries import _TOK
from jobweave.plans.people_queries import SQL as PEOPLE
from jobweave.plans.people_queries import _levels, _needs, learning_plans, profiles
from jobweave.plans.questions import plans_for
from jobweave.plans.sql import all_blank_trim
from jobweave.sources.tables import table

QUESTION = "2025年哪些城市的岗位最多，前5名"


def _changes(s: SparkSession, d: str) -> DataFrame:
    return E.changes(E.skill_rates(table(s, d, "governed_skill"), table(s, d, "governed"), YEARS), YEARS)


def _discovered(s: SparkSession, d: str) -> DataFrame:
    return P.discovered(P.title_years(table(s, d, "governed")))


def explained_changes(s: SparkSession, d: str) -> DataFrame:
    return R.explained(_changes(s, d)).drop("confidence")


def net_momentum(s: SparkSession, d: str) -> DataFrame:
    return R.net_momentum(R.explained(_changes(s, d)))


def _report(s: SparkSession, d: str) -> DataFrame:
    """Every profile against the listed roles only."""
    listed = table(s, d, "job_role").select(F.trim("role_name").alias("role")).distinct()
    needs = _needs(s, d).join(F.broadcast(listed), "role", "left_semi")  # the reference list
    return R.match_report(M.match_profiles(profiles(s, d), needs, _levels(s, d)), table(s, d, "job_role"), table(s, d, "documents"))


def match_reports(s: SparkSession, d: str) -> DataFrame:
    return _report(s, d).select("id", "role_id", "overall", "place", "tech_stack", "level_name", "source")


def plan_reports(s: SparkSession, d: str) -> DataFrame:
    return R.plan_report(learning_plans(s, d), _report(s, d)).select("id", "stage", "skill", "hours", "role_id", "overall", "source")


def discovered_details(s: SparkSession, d: str) -> DataFrame:
    return R.discovered_details(_discovered(s, d), table(s, d, "governed_skill"), table(s, d, "governed"))


def refreshed_jobs(s: SparkSession, d: str) -> DataFrame:
    """Stored governed rows with a fresh pass over the raw postings: derived columns refreshed, manual and deleted rows as they were."""
    columns = {"title_standard": "title", "tech_stack": "tech_stack", "level_name": "level_name", "published_year": "year", "skill_count": "skill_count", "quality_score": "quality_score", "stale_score": "stale_score", "valid_for_analysis": "valid", "governance_status": "status"}
    new = _governed(s, d).select(F.col("raw_id").alias("raw_job_id"), *[F.col(v).alias(k) for k, v in columns.items()])
    old = table(s, d, "governed").withColumns({c: F.col(c).cast("double") for c in ("quality_score", "stale_score")})
    return G.merge_jobs(old, new, "raw_job_id", list(columns))


def pending_counts(s: SparkSession, d: str) -> DataFrame:
    return L.pending(table(s, d, "governed"), table(s, d, "governed_skill")).groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.round(F.max("risk"), 6).alias("riskiest"))


def answer_evidence(s: SparkSession, d: str) -> DataFrame:
    """A question's first plan with its answer as evidence rows: what was asked, then the values in order."""
    return R.evidence_of(plans_for(QUESTION)[0], table(s, d, "governed"), table(s, d, "governed_skill")).select("place", "kind", F.regexp_extract("evidence", r"(?:value=|year=)([^;]*)", 1).alias("told"))


def role_requirements(s: SparkSession, d: str) -> DataFrame:
    """Requirements of roles out of this year's postings; for roles without any, those of all years."""
    needs = lambda where: M.requirements(table(s, d, "governed_skill"), table(s, d, "governed").where(where))
    return R.with_fallback(needs("published_year = 2026"), needs("true"), "role")


def compacted_history(s: SparkSession, d: str) -> DataFrame:
    """The last four documents of each source, oldest first, clipped at 520 characters."""
    last = L.last_per_key(table(s, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "crawled_at", "text"), "source", "crawled_at", "doc_id", 4)
    return last.select("doc_id", "source", "place", F.substring("text", 1, 520).alias("said"))


def skill_stacks(s: SparkSession, d: str) -> DataFrame:
    """Every spelling of the relation with its stack and category in the list, a default where it has none."""
    listed = table(s, d, "skill").select(F.col("canonical_name").alias("skill_name"), "tech_stack", "category")
    named = table(s, d, "governed_skill").where("skill_name is not null").select("skill_name").distinct().join(F.broadcast(listed), "skill_name", "left")  # the reference list
    return named.select("skill_name", F.coalesce("tech_stack", F.lit("其他")).alias("stack"), F.coalesce("category", F.lit("其他技能")).alias("category"))


QUERIES = {f.__name__: f for f in (role_requirements, compacted_history, skill_stacks, explained_changes, net_momentum, match_reports, plan_reports, discovered_details, refreshed_jobs, pending_counts, answer_evidence)} | {
    "presented_candidates": lambda s, d: R.presented(table(s, d, "raw_job").select("id", "title"), "title"),
    "resume_likeness": lambda s, d: table(s, d, "documents").select("doc_id", resume_likeness(F.coalesce("text", F.lit(""))).alias("points")),
    "unparsed_postings": lambda s, d: R.left_out(table(s, d, "raw_job"), table(s, d, "governed"), "id", "raw_job_id", "source_dataset"),
    "evidence_coverage": lambda s, d: R.coverage(table(s, d, "governed_skill"), "origin_type", "evidence_text"),
    "recent_copies": lambda s, d: R.recent_copies(table(s, d, "raw_job"), "id", "title"),
    "row_positions": lambda s, d: R.positions(table(s, d, "governed").select("raw_job_id"), "raw_job_id", 16),
    "newest_documents": lambda s, d: R.newest(table(s, d, "documents"), "doc_id", 500, "source", "doc_kind"),
    "newest_relations": lambda s, d: R.newest(table(s, d, "governed_skill"), "id", 100, "raw_job_id", "skill_name"),
    "variant_skills": lambda s, d: R.variant_skills(table(s, d, "governed_skill"), table(s, d, "governed"), ["隐私采集工程师", "Edge Integration Engineer", "边缘平台工程师", "矿山集成工程师"]),
}

_PCT = lambda x: f"printf('%.1f', round({x} * 1000) / 10) || '%'"
_PP = lambda x: f"CASE WHEN round({x}, 1) >= 0 THEN '+' ELSE '' END || printf('%.1f', round({x}, 1)) || 'pp'"
_TREND = "CASE " + " ".join(f"WHEN change = '{c}' THEN '{w}'" for c, w in R.TRENDS) + " ELSE '升温' END"
_EXPLAINED = f"""SELECT title_standard, skill_name, change, confidence, '证据覆盖由 ' || {_PCT('old_rate')} || ' 变化到 ' || {_PCT('new_rate')} || '，预测净影响 ' || {_PP('forecast_delta')} || '。“' || title_standard || ' · ' || skill_name || '”被判定为' || {_TREND} || '信号，证据 ' || evidence || ' 条。' AS explanation FROM ({ANALYSES['evolution_changes']})"""
_SIZE = lambda f, least: f"greatest({least}::DOUBLE, abs(CASE WHEN diff <> 0 THEN diff ELSE coalesce(confidence, 0.5::DOUBLE) * {f} END))"
_MATCHED_LISTED = PEOPLE["match_confusion"].split(" SELECT label", 1)[0]
_PLANS = PEOPLE["learning_plans"]
_SCENE = "CASE " + " ".join(f"WHEN contains(stack, '{w}') THEN '{v}'" for w, v in R.DEFAULT_SCENARIOS) + f" ELSE '{R.OTHER_SCENARIO}' END"
_REFRESHED = {"title_standard": "title", "tech_stack": "tech_stack", "level_name": "level_name", "published_year": "year", "skill_count": "skill_count", "quality_score": "quality_score", "stale_score": "stale_score", "valid_for_analysis": "valid", "governance_status": "status"}
_STAYS = "n.raw_id IS NULL OR coalesce(o.manual_modified = 1 OR o.is_deleted = 1, false)"
_Y26 = NEEDS.replace(TITLED, f"{TITLED} AND published_year = 2026")
_TITLE_TOKENS = _TOK.replace("(text)", "(title)")
SQL = {
    "role_requirements": f"WITH a AS ({_Y26}), b AS ({NEEDS}) SELECT *, 'snapshot' AS origin FROM a UNION ALL SELECT *, 'published' FROM b WHERE role NOT IN (SELECT role FROM a)",
    "compacted_history": "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY back DESC) AS place, substring(text, 1, 520) AS said FROM (SELECT doc_id, coalesce(source, '') AS source, text, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY crawled_at DESC, doc_id DESC) AS back FROM documents) WHERE back <= 4",
    "skill_stacks": "SELECT DISTINCT s.skill_name, coalesce(k.tech_stack, '其他') AS stack, coalesce(k.category, '其他技能') AS category FROM zhitu_governed_job_skill s LEFT JOIN skill k ON k.canonical_name = s.skill_name WHERE s.skill_name IS NOT NULL",
    "resume_likeness": "SELECT doc_id, CASE WHEN length(coalesce(text, '')) < 80 THEN 0 ELSE " + " + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {n} ELSE 0 END" for n, p in SIGNS) + " END AS points FROM documents",
    "unparsed_postings": "SELECT source_dataset, count(*) FILTER (id IN (SELECT raw_job_id FROM zhitu_governed_job)) AS parsed, count(*) FILTER (id NOT IN (SELECT raw_job_id FROM zhitu_governed_job)) AS left FROM dataset_job_raw GROUP BY 1",
    "evidence_coverage": "SELECT coalesce(origin_type, '') AS origin_type, count(*) AS rows, count(*) FILTER (trim(evidence_text) <> '') AS told, round(count(*) FILTER (trim(evidence_text) <> '') / count(*), 6) AS share FROM zhitu_governed_job_skill GROUP BY 1",
    "recent_copies": f"""WITH w AS (SELECT id, t, row_number() OVER (ORDER BY id) AS p FROM (SELECT id, {_TITLE_TOKENS} AS t FROM dataset_job_raw) WHERE len(t) > 0),
      s AS (SELECT b.id, a.id AS copy_of, a.p, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 6) AS similarity FROM w b JOIN w a ON a.p < b.p AND b.p - a.p <= 200 AND list_has_any(a.t, b.t))
      SELECT id, arg_max(copy_of, p) AS copy_of, arg_max(similarity, p) AS similarity FROM s WHERE similarity >= 0.82 GROUP BY 1""",
    "row_positions": "SELECT raw_job_id, row_number() OVER (ORDER BY raw_job_id) AS position FROM zhitu_governed_job",
    "explained_changes": f"SELECT title_standard, skill_name, change, explanation FROM ({_EXPLAINED})",
    "net_momentum": f"""WITH x AS (SELECT *, list_transform(regexp_extract_all(explanation, '([0-9]+(?:\\.[0-9]+)?)%', 1), lambda v: CAST(v AS DOUBLE)) AS f FROM ({_EXPLAINED})),
      z AS (SELECT *, CASE WHEN len(f) >= 2 THEN f[-1] - f[1] WHEN len(f) = 1 THEN f[1] ELSE 0.0::DOUBLE END AS diff FROM x)
      SELECT title_standard, count(*) AS changes, round(sum(round(CASE WHEN change = 'WEAKENED' THEN -{_SIZE(18, 1.0)} WHEN change = 'ADDED' THEN {_SIZE(16, 1.0)} ELSE {_SIZE(6, 0.5)} END, 4)), 2) AS net FROM z GROUP BY 1""",
    "match_reports": f"{_MATCHED_LISTED} SELECT m.id, j.id AS role_id, m.overall, m.place, j.tech_stack, j.level_name, d.source FROM matched m JOIN job_role j ON trim(j.role_name) = m.role JOIN documents d ON d.doc_id = m.id",
    "plan_reports": f"""WITH pl AS ({_PLANS}), mr AS ({_MATCHED_LISTED} SELECT m.id, j.id AS role_id, m.overall, d.source FROM matched m JOIN job_role j ON trim(j.role_name) = m.role JOIN documents d ON d.doc_id = m.id WHERE m.place = 1)
      SELECT pl.id, stage, skill, hours, role_id, overall, source FROM pl JOIN mr ON mr.id = pl.id""",
    "discovered_details": f"""WITH w AS (SELECT year, shown FROM ({ANALYSES['discovered_roles']})), r AS (SELECT raw_job_id, published_year AS year, title_standard AS shown, tech_stack, nullif(trim(industry), '') AS industry FROM zhitu_governed_job WHERE {OK} AND {TITLED} AND (published_year, title_standard) IN (SELECT (year, shown) FROM w)),
      n AS (SELECT year, shown, skill_name, count(*) AS n FROM r JOIN (SELECT DISTINCT raw_job_id, skill_name FROM zhitu_governed_job_skill WHERE skill_name IS NOT NULL) USING (raw_job_id) GROUP BY 1, 2, 3),
      s AS (SELECT year, shown, string_agg(skill_name, '|' ORDER BY p) AS skills FROM (SELECT *, row_number() OVER (PARTITION BY year, shown ORDER BY n DESC, skill_name) AS p FROM n) WHERE p <= 8 GROUP BY 1, 2),
      i AS (SELECT year, shown, string_agg(industry, '|' ORDER BY p) AS industry FROM (SELECT *, row_number() OVER (PARTITION BY year, shown ORDER BY n DESC, industry) AS p FROM (SELECT year, shown, industry, count(*) AS n FROM r WHERE industry IS NOT NULL GROUP BY 1, 2, 3)) WHERE p <= 3 GROUP BY 1, 2),
      t AS (SELECT year, shown, coalesce(max(nullif(trim(tech_stack), '')), '新一代信息技术') AS stack FROM r GROUP BY 1, 2)
      SELECT w.year, w.shown, coalesce(s.skills, '') AS skills, t.stack, CASE WHEN i.industry IS NOT NULL THEN i.industry || ' · ' || {_SCENE} ELSE {_SCENE} END AS scenarios FROM w LEFT JOIN s USING (year, shown) LEFT JOIN i USING (year, shown) LEFT JOIN t USING (year, shown)""",
    "refreshed_jobs": f"""WITH n AS ({GOVERNANCE['governed_rows']}) SELECT coalesce(o.raw_job_id, n.raw_id) AS raw_job_id, {", ".join(f"CASE WHEN {_STAYS} THEN o.{k} ELSE n.{v} END AS {k}" for k, v in _REFRESHED.items())}, coalesce(o.manual_modified, 0) AS manual_modified, coalesce(o.is_deleted, 0) AS is_deleted
      FROM (SELECT * REPLACE (CAST(quality_score AS DOUBLE) AS quality_score, CAST(stale_score AS DOUBLE) AS stale_score) FROM zhitu_governed_job) o FULL JOIN n ON o.raw_job_id = n.raw_id""",
    "pending_counts": f"SELECT kind, count(*) AS rows, round(max(risk), 6) AS riskiest FROM ({LISTINGS['pending_reviews']}) GROUP BY 1",
    "answer_evidence": f"SELECT 0 AS place, 'TOP_CITIES' AS kind, '2025' AS told UNION ALL SELECT row_number() OVER (ORDER BY job_count DESC, value), 'TOP_CITIES', value FROM ({PEOPLE['answered_question']})",
    "newest_documents": "SELECT doc_id, source, doc_kind FROM documents ORDER BY doc_id DESC LIMIT 500",
    "newest_relations": "SELECT id, raw_job_id, skill_name FROM zhitu_governed_job_skill ORDER BY id DESC LIMIT 100",
    "variant_skills": f"SELECT s.skill_name, count(*) AS mentions, count(DISTINCT s.raw_job_id) AS postings FROM zhitu_governed_job_skill s JOIN zhitu_governed_job g USING (raw_job_id) WHERE s.skill_name IS NOT NULL AND {OK} AND trim(g.title_standard) IN ('隐私采集工程师', 'Edge Integration Engineer', '边缘平台工程师', '矿山集成工程师') GROUP BY 1",
}
SQL = all_blank_trim(SQL)
