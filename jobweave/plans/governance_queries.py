"""Governance queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.functions import text as T
from jobweave.operators import governance as G
from jobweave.operators.schema_map import canonical
from jobweave.plans.sql import all_blank_trim
from jobweave.sources.tables import table


def _raw(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "raw_job")


def _counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "governed_skill").where("skill_name is not null").groupBy(F.col("raw_job_id").alias("raw_id")).agg(F.countDistinct("skill_name").alias("skill_count"))


def _governed(s: SparkSession, d: str) -> DataFrame:
    return G.govern(canonical(_raw(s, d)), _counts(s, d))


def governed_rows(s: SparkSession, d: str) -> DataFrame:
    columns = ("raw_id", "title", "year", "tech_stack", "level_name", "skill_count", "quality_score", "stale_score", "valid", "status")
    return _governed(s, d).select(*columns)


def governed_by_skills(s: SparkSession, d: str) -> DataFrame:
    """The stack of each posting by the stacks of its skills, in the order they were found."""
    found = table(s, d, "governed_skill").where("skill_name is not null").groupBy(F.col("raw_job_id").alias("raw_id")).agg(
        F.countDistinct("skill_name").alias("skill_count"), F.transform(F.sort_array(F.collect_list(F.when(F.col("tech_stack").isNotNull(), F.struct("id", "tech_stack")))), lambda x: x["tech_stack"]).alias("stacks")
    )  # as many as a posting has skills
    return G.govern(canonical(_raw(s, d)), found).select("raw_id", "tech_stack")


def upserted_jobs(s: SparkSession, d: str) -> DataFrame:
    """Governed rows merged with a fresh pass over the raw postings."""
    new = canonical(_raw(s, d)).select(F.col("raw_id").alias("raw_job_id"), "company", "city", "education")
    return G.merge_jobs(table(s, d, "governed"), new, "raw_job_id", ["company", "city", "education"])


def folded_edits(s: SparkSession, d: str) -> DataFrame:
    """Manual rows as edit events on the raw postings."""
    edits = table(s, d, "governed").where("manual_modified = 1").select(F.col("raw_job_id").alias("id"), "company", "city", "manual_modified_at", "governed_at")
    return G.fold_edits(_raw(s, d).select("id", "company", "city"), edits, "id", ["company", "city"], ["manual_modified_at", "governed_at"])


def holdout_leaks(s: SparkSession, d: str) -> DataFrame:
    """Rows before and after the holdout is taken out, and how many held rows are left (0)."""
    held = G.holdout_sample(_raw(s, d), 2026, 100, "md5")
    jobs = table(s, d, "governed").select("raw_job_id", "published_year")
    kept = G.without_holdout(jobs, held, "raw_job_id")
    left = kept.join(held, F.col("raw_job_id") == F.col("raw_id"), "left_semi").agg(F.count(F.lit(1)).alias("leaked"))
    return jobs.agg(F.count(F.lit(1)).alias("before")).crossJoin(kept.agg(F.count(F.lit(1)).alias("after"))).crossJoin(left)  # one row each


QUERIES = {
    "canonical_projection": lambda s, d: canonical(_raw(s, d)).withColumn("published_at", F.col("published_at").cast("string")),
    "clean_descriptions": lambda s, d: _raw(s, d).select("id", T.clean_description(F.col("description")).alias("cleaned")),
    "standard_titles": lambda s, d: _raw(s, d).select("id", T.standard_title(F.col("title")).alias("standard")),
    "template_hashes": lambda s, d: _raw(s, d).select("id", F.sha2(T.template_text(F.col("description")), 256).alias("template")),
    "content_keys": lambda s, d: _raw(s, d).select("id", G.content_key(F.col("title"), F.col("description"), F.col("company")).alias("key")),
    "governed_rows": governed_rows,
    "governed_by_skills": governed_by_skills,
    "governance_issues": lambda s, d: G.issues(_governed(s, d)),
    "duplicate_clusters": lambda s, d: G.duplicate_clusters(table(s, d, "governed"), "raw_job_id", "template_hash", (F.col("valid_for_analysis") == 1) & (F.col("is_deleted") == 0)),
    "finished_duplicates": lambda s, d: G.finish_duplicates(table(s, d, "governed")),
    "holdout_crc32": lambda s, d: G.holdout_sample(_raw(s, d), 2026, 100),
    "holdout_md5": lambda s, d: G.holdout_sample(_raw(s, d), 2026, 100, "md5"),
    "holdout_leaks": holdout_leaks,
    "upserted_jobs": upserted_jobs,
    "merged_skills": lambda s, d: G.merge_skills(table(s, d, "governed_skill")),
    "folded_edits": folded_edits,
    "deduplicated_load": lambda s, d: G.deduplicate_load(_raw(s, d)).select("id", "source_dataset"),
    "requirement_types": lambda s, d: table(s, d, "governed_skill").select("id", G.requirement_type(F.col("evidence_text")).alias("kind"), G.requirement_confidence(F.col("evidence_text")).alias("confidence")),
    "staleness": lambda s, d: table(s, d, "governed").select("raw_job_id", G.staleness(F.col("published_year"), 2026).alias("stale")),
}

_JT = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
_SP = lambda x: _JT.format(f"regexp_replace({x}, '[ \\t\\n\\f\\r\\x0b]+', ' ', 'g')")
_R = lambda x, p, r: f"regexp_replace({x}, '{p}', '{r}', 'g')"
_JAVA_S = r"[ \t\n\x0b\f\r]"


def _re2(pattern: str) -> str:
    """A pattern as RE2 reads it the same way: white space is the ASCII set."""
    return pattern.replace(r"\s", _JAVA_S).replace(r"\S", r"[^ \t\n\x0b\f\r]").replace("'", "''")


_CLEAN = "coalesce(description, '')"
for _p in (T.HTML, T.CONTACT_LINE, T.ADVERT):
    _CLEAN = _R(_CLEAN, _re2(_p), " ")
_CLEAN = _R(_R(_R(f"replace({_CLEAN}, chr(160), ' ')", r"[\t\r]+", " "), "[ ]{2,}", " "), r"\n{3,}", "' || chr(10) || chr(10) || '")
_CLEAN = f"substring({_JT.format(_CLEAN)}, 1, 60000)"
_TITLE = _R(_R(_R("coalesce(title, '')", T.TITLE_BRACKETS, " "), T.TITLE_NOISE, " "), r"[|丨/\\]+", " ")
_TITLE = _JT.format(f"substring({_SP(_TITLE)}, 1, 120)")
_HAN = r"[^a-z0-9\x{4e00}-\x{9fff}+#.]"


def _template(x: str) -> str:
    body = _R(_R(_R(_R(f"lower({x})", r"[0-9]+(?:\.[0-9]+)?", "#"), "[a-f0-9]{16,}", "#"), T.TEMPLATE_WORDS, " "), _HAN, " ")
    return f"CASE WHEN trim({x}) = '' THEN 'EMPTY' ELSE substring({_SP(body)}, 1, 2500) END"


def _case(x: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN {v!r}" for v, p in rules) + f" ELSE {default} END"


_TEN = "substring(trim(posting_date), 1, 10)"
_CANON = f"""SELECT id AS raw_id, coalesce(trim(title), '') AS raw_title, coalesce(trim(company), '') AS company, coalesce(trim(description), '') AS description, coalesce(trim(city), '') AS city,
  coalesce(trim(education), '') AS education, coalesce(trim(experience), '') AS experience, coalesce(trim(source_platform), '') AS source_name, coalesce(trim(industry), '') AS industry,
  TRY_CAST(salary_min AS DECIMAL(12,2)) AS salary_min, TRY_CAST(salary_max AS DECIMAL(12,2)) AS salary_max,
  coalesce(CASE WHEN regexp_matches({_TEN}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_CAST({_TEN} AS DATE) END,
    CASE WHEN regexp_matches({_TEN}, '^[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}$') THEN TRY_CAST(replace({_TEN}, '/', '-') AS DATE) END,
    CASE WHEN posting_year BETWEEN 1 AND 9999 THEN make_date(posting_year, 1, 1) END) AS published_at,
  posting_year AS published_year FROM dataset_job_raw"""
_GOV = f"""WITH c AS ({_CANON}), k AS (SELECT raw_job_id AS raw_id, count(DISTINCT skill_name) AS skill_count FROM zhitu_governed_job_skill WHERE skill_name IS NOT NULL GROUP BY 1),
p AS (SELECT c.raw_id, {_TITLE.replace("coalesce(title, '')", "raw_title")} AS title, substring({_SP('company')}, 1, 300) AS company, substring({_SP('experience')}, 1, 200) AS experience,
  {_CLEAN} AS description, coalesce(CASE WHEN published_year BETWEEN 2000 AND 2100 THEN published_year END, year(published_at)) AS year, coalesce(k.skill_count, 0) AS skill_count FROM c LEFT JOIN k USING (raw_id)),
q AS (SELECT *, title || chr(10) || description AS body, round(least(1.0::DOUBLE, CASE WHEN trim(title) <> '' THEN 0.22::DOUBLE ELSE 0 END + CASE WHEN trim(company) <> '' THEN 0.10::DOUBLE ELSE 0 END
  + CASE WHEN length(description) >= 40 THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN length(description) >= 150 THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(description, '{G.DUTY_WORDS}') THEN 0.12::DOUBLE ELSE 0 END
  + CASE WHEN skill_count > 0 THEN 0.14::DOUBLE ELSE 0 END + CASE WHEN skill_count >= 3 THEN 0.06::DOUBLE ELSE 0 END + CASE WHEN year IS NOT NULL THEN 0.08::DOUBLE ELSE 0 END), 6) AS quality_score FROM p)"""
_VALID = f"trim(title) <> '' AND length(description) >= 20 AND year IS NOT NULL AND quality_score >= {G.MINIMUM_QUALITY}"
_MD5 = "SELECT id AS raw_id, 2026 AS holdout_year FROM dataset_job_raw WHERE posting_year = 2026 ORDER BY md5(CAST(id AS VARCHAR) || ':20260101'), id LIMIT 100"
_CLUSTER = "SELECT template_hash, min(raw_job_id) AS root_id, count(*) AS member_count FROM zhitu_governed_job WHERE is_deleted = 0 AND valid_for_analysis = 1 AND template_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1"
_KEEP = "n.raw_job_id IS NULL OR coalesce(o.manual_modified = 1 OR o.is_deleted = 1, false)"
SQL = {
    "canonical_projection": f"SELECT * REPLACE (CAST(published_at AS VARCHAR) AS published_at) FROM ({_CANON})",
    "clean_descriptions": f"SELECT id, {_CLEAN} AS cleaned FROM dataset_job_raw",
    "standard_titles": f"SELECT id, {_TITLE} AS standard FROM dataset_job_raw",
    "template_hashes": f"SELECT id, sha256({_template('coalesce(description, $$$$)')}) AS template FROM dataset_job_raw",
    "content_keys": f"SELECT id, sha256({_SP('lower(coalesce(title, $$$$) || chr(10) || coalesce(description, $$$$) || chr(10) || coalesce(company, $$$$))')}) AS key FROM dataset_job_raw",
    "governed_rows": f"""{_GOV} SELECT raw_id, title, year, {_case('lower(body)', G.STACKS, "'人工智能'")} AS tech_stack, {_case("lower(body || ' ' || experience)", G.LEVELS, "'未标注'")} AS level_name, skill_count,
      quality_score, CASE WHEN year IS NULL THEN 1 ELSE round(least(greatest((2026 - year) / 8.0::DOUBLE, 0), 1), 6) END AS stale_score, CAST({_VALID} AS INTEGER) AS valid, CASE WHEN {_VALID} THEN 'CLEANED' ELSE 'LOW_QUALITY' END AS status FROM q""",
    "governance_issues": f"""{_GOV} SELECT raw_id, 'MISSING_FIELD' AS issue_type, 'title' AS field_name, 'HIGH' AS severity FROM q WHERE trim(title) = '' UNION ALL
      SELECT raw_id, 'LOW_CONTENT', 'description', 'HIGH' FROM q WHERE length(description) < 20 UNION ALL SELECT raw_id, 'MISSING_YEAR', 'published_year', 'HIGH' FROM q WHERE year IS NULL UNION ALL
      SELECT raw_id, 'NO_SKILL', 'skills', 'MEDIUM' FROM q WHERE skill_count = 0""",
    "duplicate_clusters": _CLUSTER,
    "finished_duplicates": f"""SELECT raw_job_id, 'TPL-' || CAST(root_id AS VARCHAR) AS new_group, CASE WHEN member_count IS NULL THEN 1 ELSE round(greatest(0.15::DOUBLE, 1 / sqrt(member_count)), 6) END AS new_weight,
      CASE WHEN manual_modified = 1 THEN governance_status WHEN member_count IS NOT NULL THEN 'DUPLICATE_REVIEW' WHEN valid_for_analysis = 1 THEN 'CLEANED' ELSE 'LOW_QUALITY' END AS new_status
      FROM zhitu_governed_job j LEFT JOIN ({_CLUSTER}) c ON j.template_hash = c.template_hash WHERE is_deleted = 0""",
    "holdout_md5": _MD5,
    "holdout_leaks": f"""WITH h AS ({_MD5}) SELECT count(*) AS before, count(*) FILTER (raw_job_id NOT IN (SELECT raw_id FROM h)) AS after, 0::BIGINT AS leaked FROM zhitu_governed_job""",
    "upserted_jobs": f"""WITH n AS (SELECT id AS raw_job_id, coalesce(trim(company), '') AS company, coalesce(trim(city), '') AS city, coalesce(trim(education), '') AS education FROM dataset_job_raw)
      SELECT coalesce(o.raw_job_id, n.raw_job_id) AS raw_job_id, {", ".join(f"CASE WHEN {_KEEP} THEN o.{c} ELSE n.{c} END AS {c}" for c in ("company", "city", "education"))},
      coalesce(o.manual_modified, 0) AS manual_modified, coalesce(o.is_deleted, 0) AS is_deleted FROM zhitu_governed_job o FULL JOIN n ON o.raw_job_id = n.raw_job_id""",
    "merged_skills": """SELECT raw_job_id, skill_name, id, c AS confidence, rows FROM (SELECT raw_job_id, skill_name, id, coalesce(CAST(confidence AS DOUBLE), 0) AS c, count(*) OVER (PARTITION BY raw_job_id, skill_name) AS rows,
      row_number() OVER (PARTITION BY raw_job_id, skill_name ORDER BY CASE WHEN upper(coalesce(origin_type, '')) = 'MANUAL' THEN 0 ELSE 1 END, coalesce(CAST(confidence AS DOUBLE), 0) DESC, id) AS k
      FROM zhitu_governed_job_skill WHERE skill_name IS NOT NULL) WHERE k = 1""",
    "folded_edits": """SELECT r.id, coalesce(g.company, r.company) AS company, coalesce(g.city, r.city) AS city, CASE WHEN g.raw_job_id IS NULL THEN 0 ELSE 1 END AS edits
      FROM dataset_job_raw r LEFT JOIN (SELECT * FROM zhitu_governed_job WHERE manual_modified = 1) g ON r.id = g.raw_job_id""",
    "deduplicated_load": "SELECT min(id) AS id, source_dataset FROM dataset_job_raw WHERE trim(content_hash) <> '' GROUP BY source_dataset, content_hash UNION ALL SELECT id, source_dataset FROM dataset_job_raw WHERE coalesce(trim(content_hash), '') = ''",
    "governed_by_skills": f"""{_GOV}, h AS (SELECT raw_job_id AS raw_id, tech_stack AS s, id FROM zhitu_governed_job_skill WHERE skill_name IS NOT NULL AND tech_stack IS NOT NULL),
      m AS (SELECT raw_id, arg_max(s, (n, -first)) AS stack FROM (SELECT raw_id, s, count(*) AS n, min(id) AS first FROM h GROUP BY 1, 2) GROUP BY 1)
      SELECT q.raw_id, coalesce(m.stack, {_case('lower(body)', G.STACKS, "'人工智能'")}) AS tech_stack FROM q LEFT JOIN m USING (raw_id)""",
    "requirement_types": f"""SELECT id, {_case("lower(coalesce(evidence_text, ''))", G.REQUIREMENTS, "'MENTIONED'")} AS kind, {_case("lower(coalesce(evidence_text, ''))", G.CONFIDENCES, "0.74")}::DOUBLE AS confidence FROM zhitu_governed_job_skill""",
    "staleness": "SELECT raw_job_id, CASE WHEN published_year IS NULL THEN 1 ELSE round(least(greatest((2026 - published_year) / 8.0::DOUBLE, 0), 1), 6) END AS stale FROM zhitu_governed_job",
}
SQL = {k: v.replace("$$$$", "''") for k, v in SQL.items()}

SQL = all_blank_trim(SQL)
