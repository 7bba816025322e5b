"""Extraction, matching, document and event queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.operators import documents as D
from jobweave.operators import extraction as X
from jobweave.operators import governance as G
from jobweave.operators import matching as M
from jobweave.functions.measures import analysable, blank_null
from jobweave.functions.text import lowered
from jobweave.functions.titles import clean_title, plausible_title
from jobweave.operators.listings import dominant
from jobweave.operators.market import run_plan
from jobweave.operators.multivalue import split_values
from jobweave.operators.resume import parse_profiles
from jobweave.plans.governance_queries import _SP, _case
from jobweave.plans.market_queries import JOINED, OK, TITLED
from jobweave.plans.questions import plans_for
from jobweave.plans.sql import all_blank_trim
from jobweave.sources.tables import table
from jobweave.streaming import events as E

# Where sentences end, and what tells projects and internships apart.
SENTENCE_END = r"[。；;\n]|\. "
PROJECT_WORD, INTERN_WORD = r"项目|project|The candidate", r"实习|\b[Ii]ntern\b"


def _resumes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("doc_kind = 'resume'").select("doc_id", "text")


def _names(s: SparkSession, d: str, aliases: bool = False) -> DataFrame:
    skills = table(s, d, "skill")
    return X.dictionary(skills, split_values(skills, "id", "aliases") if aliases else None)


def skill_mentions(s: SparkSession, d: str) -> DataFrame:
    return X.skill_mentions(table(s, d, "documents").select("doc_id", "text"), _names(s, d), "doc_id", "text")


def alias_mentions(s: SparkSession, d: str) -> DataFrame:
    """Mentions by canonical names and all aliases."""
    return X.skill_mentions(table(s, d, "documents").select("doc_id", "text"), _names(s, d, True), "doc_id", "text")


def extraction_agreement(s: SparkSession, d: str) -> DataFrame:
    jobs = table(s, d, "governed").select("raw_job_id", "description_clean")
    named = table(s, d, "skill").select(F.col("id").alias("skill_id"), F.lower(F.trim("canonical_name")).alias("name")).where("name is not null")
    found = X.skill_mentions(jobs, _names(s, d), "raw_job_id", "description_clean").join(named, "skill_id").select("raw_job_id", "name")
    gold = table(s, d, "governed_skill").select("raw_job_id", F.lower(F.trim("skill_name")).alias("name")).join(named.select("name").distinct(), "name", "left_semi")
    return X.agreement(found, gold, ["raw_job_id", "name"])


def profiles(s: SparkSession, d: str) -> DataFrame:
    """Profiles out of running text: skills, texts on projects and internships, longest stated years, education."""
    resumes = _resumes(s, d)
    named = table(s, d, "skill").select(F.col("id").alias("skill_id"), "canonical_name")
    found = X.skill_mentions(resumes, _names(s, d), "doc_id", "text").join(F.broadcast(named), "skill_id")  # as many rows as the dictionary, whose size is checked there
    skills = found.groupBy("doc_id").agg(F.sort_array(F.collect_set("canonical_name")).alias("skills"))  # at most the dictionary
    years = F.coalesce(F.array_max(F.transform(F.regexp_extract_all("text", F.lit(r"(?:做了|spent )([0-9]{1,2})(?:年| years)"), F.lit(1)), lambda y: y.cast("double"))), F.lit(0.0))
    education = F.when(F.col("text").rlike("博士|硕士"), "硕士").when(F.contains("text", F.lit("本科")), "本科")
    told = F.split("text", SENTENCE_END)
    return resumes.join(skills, "doc_id").select(
        F.col("doc_id").alias("id"), "skills", F.array_join(F.filter(told, lambda t: t.rlike(PROJECT_WORD)), "\n").alias("projects"),
        F.filter(told, lambda t: t.rlike(INTERN_WORD)).alias("internships"), years.alias("years"), education.alias("education"),
    )


def _needs(s: SparkSession, d: str) -> DataFrame:
    return M.requirements(table(s, d, "governed_skill"), table(s, d, "governed"))


def _levels(s: SparkSession, d: str) -> DataFrame:
    """(role, level): that of the reference list, else the most frequent one of the role's postings."""
    listed = table(s, d, "job_role").select(F.trim("role_name").alias("role"), blank_null("level_name").alias("listed")).where("listed is not null")
    usual = dominant(table(s, d, "governed").where(analysable()), blank_null("title_standard"), "level_name").select(F.col("key").alias("role"), F.col("value").alias("usual"))
    return usual.join(listed, "role", "full_outer").select("role", F.coalesce("listed", "usual").alias("level"))


def _matches(s: SparkSession, d: str) -> DataFrame:
    return M.match_profiles(profiles(s, d), _needs(s, d), _levels(s, d))


def matched_profiles(s: SparkSession, d: str) -> DataFrame:
    return _matches(s, d).withColumn("missing", F.size("missing"))


def match_confusion(s: SparkSession, d: str) -> DataFrame:
    """Bands of the best listed roles of each profile against the role its document was written for."""
    roles = table(s, d, "job_role").select(F.col("id").alias("role_id"), F.trim("role_name").alias("own"))
    needs = _needs(s, d).join(F.broadcast(roles.select(F.col("own").alias("role"))), "role", "left_semi")
    meant = table(s, d, "documents").where("role_id is not null").select(F.col("doc_id").alias("id"), "role_id").join(F.broadcast(roles), "role_id")
    judged = M.match_profiles(profiles(s, d), needs, _levels(s, d)).join(meant, "id")
    return M.confusion(judged.withColumn("label", F.when(F.col("role") == F.col("own"), "match").otherwise("mismatch")), "overall", "label")


def prerequisites(s: SparkSession, d: str) -> DataFrame:
    """(skill, place, prerequisite): a framework builds on the first language of its stack in the skill list."""
    skills = table(s, d, "skill").where("canonical_name is not null").select("id", "canonical_name", "tech_stack", "category")
    languages = skills.where("category = '语言'").groupBy("tech_stack").agg(F.min_by("canonical_name", "id").alias("prerequisite"))
    return skills.where("category = '框架'").join(languages, "tech_stack").select(F.col("canonical_name").alias("skill"), F.lit(1).alias("place"), "prerequisite")


def learning_plans(s: SparkSession, d: str) -> DataFrame:
    """Twelve weeks of eight hours for what each profile lacks for its best role, prerequisites first."""
    best = _matches(s, d).where("place = 1").select("id", "missing")
    return M.learning_plan(M.with_prerequisites(best, "id", "missing", prerequisites(s, d)), "id", F.col("skills"), F.lit(12), F.lit(8))


def documents_quality(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "text")
    with_skill = skill_mentions(s, d).select("doc_id").distinct().withColumn("has", F.lit(True))
    return docs.join(with_skill, "doc_id", "left").select("doc_id", D.quality(F.coalesce("text", F.lit("")), F.coalesce("has", F.lit(False))).alias("quality"))


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events")


def _texts(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as text, alike in both engines."""
    return df.withColumns({c: F.substring(F.col(c).cast("string"), 1, 19) for c in columns})


QUERIES = {
    "skill_mentions": skill_mentions,
    "alias_mentions": alias_mentions,
    "extraction_agreement": extraction_agreement,
    "knowledge_base": lambda s, d: X.knowledge_base(table(s, d, "governed_skill"), table(s, d, "governed")),
    "confidence_bands": lambda s, d: X.confidence_bands(table(s, d, "governed_skill")),
    "requirement_snapshot": _needs,
    "matched_profiles": matched_profiles,
    "match_confusion": match_confusion,
    "profile_skills": lambda s, d: M.skill_rows(profiles(s, d)).select("id", "skill", "in_projects", F.coalesce(F.size("internships"), F.lit(0)).alias("internships")),
    "learning_plans": learning_plans,
    "html_texts": lambda s, d: table(s, d, "raw_job").select("id", D.html_to_text(F.col("description")).alias("plain")),
    "source_hosts": lambda s, d: table(s, d, "raw_job").select("id", D.host_of(F.col("source_reference")).alias("host"), D.private_host(F.col("source_reference")).alias("private")),
    "exact_copies": lambda s, d: D.exact_copies(table(s, d, "documents"), "doc_id", "text"),
    "import_status": lambda s, d: D.import_status(table(s, d, "documents"), "doc_id", "text", "source"),
    "documents_quality": documents_quality,
    "similar_token_sets": lambda s, d: D.similar_token_sets(table(s, d, "raw_job"), "id", "title", 0.6),
    "frequent_duties": lambda s, d: D.frequent_duties(table(s, d, "governed"), "title_standard", "description_clean"),
    "lowered_hashes": lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(lowered(F.col("text")), 256).alias("hash")),
    "event_windows": lambda s, d: _texts(E.windowed_counts(_events(s, d)), "window_start"),
    "event_sessions": lambda s, d: _texts(E.sessions(_events(s, d)), "first_ts", "last_ts"),
    "event_momentum": lambda s, d: E.half_day_momentum(_events(s, d)),
    "event_properties": lambda s, d: E.property_sums(_events(s, d)),
}

_NAMES = "(SELECT id AS skill_id, lower(trim(canonical_name)) AS alias FROM skill WHERE length(trim(canonical_name)) >= 2 AND NOT regexp_matches(lower(trim(canonical_name)), '^[a-z0-9]{1,2}$'))"


def _mentions(source: str, key: str, text: str) -> str:
    return f"""(SELECT {key}, skill_id, place, trim(substring(t, greatest(1, place - 45), place + length(alias) + 65 - greatest(1, place - 45))) AS evidence FROM
      (SELECT {key}, skill_id, alias, t, strpos(t, alias) AS place FROM (SELECT {key}, lower({text}) AS t FROM {source} WHERE length({text}) > 0), {_NAMES}) WHERE place > 0)"""


_MENTION = _mentions("documents", "doc_id", "text")
_NEEDS = f"""SELECT role, skill_name, CASE WHEN b > r THEN 'BONUS' ELSE 'REQUIRED' END AS kind, round(least(greatest(s / greatest(m, 1e-9), 0.08), 1) * CASE WHEN r <= 0 AND b <= 0 THEN 0.72::DOUBLE ELSE 1 END, 6) AS importance FROM
  (SELECT *, max(s) OVER (PARTITION BY role) AS m FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY s DESC, skill_name) AS place FROM (SELECT trim(title_standard) AS role, skill_name, round(sum(support), 6) AS s,
  sum(CASE WHEN kind = 'REQUIRED' THEN support ELSE 0 END) AS r, sum(CASE WHEN kind IN ('BONUS', 'PREFERRED') THEN support ELSE 0 END) AS b FROM {JOINED} WHERE {TITLED} GROUP BY trim(title_standard), skill_name)) WHERE place <= 60)"""
_FOUND = _mentions("(SELECT doc_id, text FROM documents WHERE doc_kind = 'resume')", "doc_id", "text")
_PROFILE = f"""f AS (SELECT DISTINCT m.doc_id AS id, k.canonical_name AS s FROM {_FOUND} m JOIN skill k ON m.skill_id = k.id),
p AS (SELECT doc_id AS id, coalesce(list_max(list_transform(regexp_extract_all(text, '(?:做了|spent )([0-9]{{1,2}})(?:年| years)', 1), lambda y: CAST(y AS DOUBLE))), 0) AS years, CASE WHEN regexp_matches(text, '博士|硕士') THEN 95.0::DOUBLE WHEN contains(text, '本科') THEN 88.0::DOUBLE ELSE 60.0::DOUBLE END AS edu,
  list_filter(string_split_regex(lower(text), '{SENTENCE_END}'), lambda t: regexp_matches(t, '{INTERN_WORD}')) AS interns, array_to_string(list_filter(string_split_regex(text, '{SENTENCE_END}'), lambda t: regexp_matches(t, '{PROJECT_WORD}')), chr(10)) AS projects FROM documents WHERE doc_kind = 'resume'),
ps AS (SELECT f.id, f.s, contains(lower(p.projects), lower(f.s)) AS in_projects, list_filter(range(0, len(interns)), lambda k: contains(interns[k + 1], lower(f.s))) AS named_in FROM f JOIN p USING (id))"""
_GENERAL = "', '".join(M.GENERAL_STAGES)
_MATCHED = f"""WITH {_PROFILE}, n AS ({_NEEDS}),
lv AS (SELECT coalesce(u.role, j.role) AS role, coalesce(listed, usual) AS level FROM (SELECT key AS role, arg_min(value, (-n, value)) AS usual FROM (SELECT nullif(trim(title_standard), '') AS key, nullif(trim(level_name), '') AS value, count(*) AS n FROM zhitu_governed_job WHERE {OK} GROUP BY 1, 2) WHERE key IS NOT NULL AND value IS NOT NULL GROUP BY 1) u
  FULL JOIN (SELECT trim(role_name) AS role, nullif(trim(level_name), '') AS listed FROM job_role WHERE nullif(trim(level_name), '') IS NOT NULL) j ON u.role = j.role),
g AS (SELECT id, count(DISTINCT split_part(s, ' ', 1)) AS stacks, count(*) FILTER (in_projects) AS named FROM ps GROUP BY 1),
rel AS (SELECT id, role, count(DISTINCT k) AS relevant FROM (SELECT ps.id, n.role, unnest(ps.named_in) AS k FROM ps JOIN n ON n.skill_name = ps.s WHERE n.kind = 'REQUIRED') GROUP BY 1, 2),
hits AS (SELECT ps.id, n.role, sum(CASE WHEN kind = 'REQUIRED' THEN CAST(round(importance * 1000000) AS BIGINT) ELSE 0 END) AS hit, count(*) FILTER (kind = 'REQUIRED') AS got, count(*) FILTER (kind = 'BONUS') AS extra FROM ps JOIN n ON n.skill_name = ps.s GROUP BY 1, 2),
t AS (SELECT role, sum(CASE WHEN kind = 'REQUIRED' THEN CAST(round(importance * 1000000) AS BIGINT) ELSE 0 END) AS total, count(*) FILTER (kind = 'REQUIRED') AS wanted FROM n GROUP BY 1),
ex AS (SELECT role, max(CASE WHEN contains(coalesce(level, ''), '高') THEN 5.0::DOUBLE WHEN contains(coalesce(level, ''), '中') THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END) AS expected FROM lv GROUP BY 1),
q AS (SELECT h.id, h.role, t.wanted - h.got AS missing, least(100.0::DOUBLE, CASE WHEN total = 0 THEN 0 ELSE 100.0::DOUBLE * hit / total END + least(8, extra * 2)) AS skill, least(100.0::DOUBLE, 30 + len(interns) * 15 + coalesce(relevant, 0) * 5) AS internship, least(100.0::DOUBLE, 35 + named * 10) AS project,
  least(100.0::DOUBLE, 45 + stacks * 3) AS stack, least(100.0::DOUBLE, 60 + least(years, coalesce(expected, 1.0::DOUBLE)) / coalesce(expected, 1.0::DOUBLE) * 40) AS level, edu AS education FROM hits h JOIN t USING (role) LEFT JOIN ex USING (role) JOIN p USING (id) JOIN g USING (id) LEFT JOIN rel ON rel.id = h.id AND rel.role = h.role),
o AS (SELECT id, role, round(0.40::DOUBLE * skill + 0.18::DOUBLE * internship + 0.15::DOUBLE * project + 0.12::DOUBLE * stack + 0.09::DOUBLE * level + 0.06::DOUBLE * education + 1e-9, 1) AS overall, round(skill, 1) AS skill, round(internship, 1) AS internship, round(project, 1) AS project,
  round(stack, 1) AS stack, round(level, 1) AS level, round(education, 1) AS education, missing FROM q),
matched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overall DESC, role) AS place FROM o) WHERE place <= 5)"""
_HTML = "regexp_replace(description, '(?i)<br[ \\t\\n\\x0b\\f\\r]*/?>|</p>|</li>|</tr>|</div>', chr(10), 'g')"
_HTML = f"regexp_replace({_HTML}, '(?is)<script.*?</script>|<style.*?</style>|<[^>]+>', '', 'g')"
for _e, _s in D.ENTITIES:
    _HTML = f"replace({_HTML}, '{_e}', '{_s.replace(chr(39), chr(39) * 2)}')"
_HTML = f"regexp_replace(regexp_replace(regexp_replace({_HTML}, '[ \\t]+', ' ', 'g'), '\\n{{2,}}', chr(10), 'g'), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"
_HOST = r"lower(regexp_extract(coalesce(source_reference, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]]*\]|[^:/?#]+)', 1))"
_KEY = f"sha256({_SP('lower(text)')})"
_TOK = rf"list_sort(list_distinct(list_filter(string_split(regexp_replace({_SP('lower(text)')}, '[^\p{{L}}\p{{N}}+#.]+', ' ', 'g'), ' '), lambda t: length(t) > 1)))"
SQL = {
    "skill_mentions": f"SELECT doc_id, skill_id, place, evidence, {_case('lower(evidence)', G.REQUIREMENTS, chr(39) + 'MENTIONED' + chr(39))} AS kind, CAST({_case('lower(evidence)', G.CONFIDENCES, '0.74')} AS DOUBLE) AS confidence FROM {_MENTION}",
    "extraction_agreement": f"""WITH n AS (SELECT id AS skill_id, lower(trim(canonical_name)) AS name FROM skill WHERE canonical_name IS NOT NULL),
      f AS (SELECT DISTINCT raw_job_id, name, 1 AS f FROM {_mentions('zhitu_governed_job', 'raw_job_id', 'description_clean')} JOIN n USING (skill_id)),
      g AS (SELECT DISTINCT raw_job_id, lower(trim(skill_name)) AS name, 1 AS g FROM zhitu_governed_job_skill WHERE lower(trim(skill_name)) IN (SELECT name FROM n)),
      c AS (SELECT count(*) FILTER (f IS NOT NULL AND g IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (f IS NULL) AS fn FROM f FULL JOIN g USING (raw_job_id, name))
      SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
    "knowledge_base": f"""SELECT role_name, skill_name, kind, count(*) AS evidence_count, count(DISTINCT channel) AS source_count, round(least(0.99::DOUBLE, CASE WHEN kind = 'REQUIRED' THEN 0.84::DOUBLE ELSE 0.72::DOUBLE END + sum(step) - arg_min(step, raw_job_id)), 6) AS confidence,
      CAST(min(published_at) AS VARCHAR) AS first_seen, CAST(max(published_at) AS VARCHAR) AS last_seen FROM (SELECT DISTINCT s.raw_job_id, s.skill_name, CASE WHEN upper(coalesce(requirement_type, '')) IN ('BONUS', 'PREFERRED') THEN 'BONUS' WHEN upper(coalesce(requirement_type, '')) = 'MENTIONED' THEN 'MENTIONED' ELSE 'REQUIRED' END AS kind,
      trim(title_standard) AS role_name, trim(split_part(source_name, '|', 1), ' ') AS channel, published_at, CASE WHEN g.governance_status = 'DUPLICATE_REVIEW' THEN 0.005::DOUBLE ELSE 0.02::DOUBLE END AS step
      FROM zhitu_governed_job_skill s JOIN zhitu_governed_job g USING (raw_job_id) WHERE {OK} AND s.skill_name IS NOT NULL AND trim(title_standard) <> '') GROUP BY 1, 2, 3""",
    "confidence_bands": "SELECT coalesce(origin_type, '') AS origin, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.8 THEN 'middle' WHEN confidence IS NOT NULL THEN 'low' ELSE 'none' END AS band, count(*) AS rows FROM zhitu_governed_job_skill GROUP BY 1, 2",
    "requirement_snapshot": _NEEDS,
    "matched_profiles": f"{_MATCHED} SELECT id, role, overall, skill, internship, project, stack, level, education, place, missing FROM matched",
    "profile_skills": f"WITH {_PROFILE} SELECT id, s AS skill, in_projects, len(named_in) AS internships FROM ps",
    "match_confusion": f"""{_MATCHED.replace(_NEEDS, f"SELECT * FROM ({_NEEDS}) WHERE role IN (SELECT trim(role_name) FROM job_role)")} SELECT label, band, count(*) AS pairs, round(avg(abs(overall - CASE label WHEN 'match' THEN 85.0::DOUBLE ELSE 27.5::DOUBLE END)), 4) AS error FROM
      (SELECT m.*, CASE WHEN m.role = trim(r.role_name) THEN 'match' ELSE 'mismatch' END AS label, CASE WHEN overall >= 70 THEN 'match' WHEN overall >= 55 THEN 'partial' ELSE 'mismatch' END AS band FROM matched m JOIN documents d ON d.doc_id = m.id JOIN job_role r ON r.id = d.role_id) GROUP BY 1, 2""",
    "learning_plans": f"""{_MATCHED}, lacking AS (SELECT b.id, n.skill_name AS s, row_number() OVER (PARTITION BY b.id ORDER BY n.skill_name) AS k FROM matched b JOIN n ON n.role = b.role AND n.kind = 'REQUIRED' LEFT JOIN ps ON ps.id = b.id AND ps.s = n.skill_name WHERE b.place = 1 AND ps.s IS NULL),
      pre AS (SELECT f.canonical_name AS s, l.prerequisite FROM skill f JOIN (SELECT tech_stack, arg_min(canonical_name, id) AS prerequisite FROM skill WHERE category = '语言' AND canonical_name IS NOT NULL GROUP BY 1) l USING (tech_stack) WHERE f.category = '框架' AND f.canonical_name IS NOT NULL),
      steps AS (SELECT id, k, 0 AS j, prerequisite AS s FROM lacking JOIN pre USING (s) UNION ALL SELECT id, k, 1, s FROM lacking UNION ALL SELECT id, i, 1, (['{_GENERAL}'])[i] FROM matched, range(1, 6) g(i) WHERE place = 1 AND id NOT IN (SELECT id FROM lacking)),
      firsts AS (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY min((k, j))) AS k FROM steps GROUP BY id, s),
      kept AS (SELECT id, s, k - 1 AS k FROM firsts WHERE k <= 5 UNION ALL SELECT id, '{M.PROJECT_STAGE}', least(5, max(k)) FROM firsts GROUP BY id),
      sized AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM kept), c AS (SELECT *, 12 // n AS base, 12 - 12 // n * n AS rest FROM sized),
      f2 AS (SELECT *, k * base + greatest(0, k - (n - rest)) + 1 AS first_week, base + CASE WHEN k >= n - rest THEN 1 ELSE 0 END AS size FROM c), g2 AS (SELECT *, CASE WHEN k = n - 1 THEN 12 ELSE least(12, first_week + size - 1) END AS last_week FROM f2)
      SELECT id, k + 1 AS stage, s AS skill, CASE WHEN k = 0 THEN '{M.TIERS[0]}' WHEN k = 1 THEN '{M.TIERS[1]}' WHEN k = n - 1 THEN '{M.TIERS[4]}' WHEN k = n - 2 THEN '{M.TIERS[3]}' ELSE '{M.TIERS[2]}' END AS tier, CASE WHEN k <= 1 THEN 'P0' WHEN s = '{M.PROJECT_STAGE}' THEN 'P2' ELSE 'P1' END AS priority,
      first_week, last_week, greatest(8, (last_week - first_week + 1) * 8) AS hours FROM g2 WHERE first_week <= last_week""",
    "html_texts": f"SELECT id, {_HTML} AS plain FROM dataset_job_raw",
    "source_hosts": f"SELECT id, {_HOST} AS host, {_HOST} = '' OR regexp_matches({_HOST}, '{D.PRIVATE_HOST}') AS private FROM dataset_job_raw",
    "exact_copies": f"SELECT {_KEY} AS key, min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "import_status": f"""WITH r AS (SELECT doc_id AS id, {_KEY.replace('(text)', "(coalesce(text, ''))")} AS key, coalesce(source, '') AS source, length(coalesce(text, '')) AS chars FROM documents)
      SELECT id, min(id) OVER (PARTITION BY key) AS first, CASE WHEN id > min(id) OVER (PARTITION BY key, source) THEN 'ALREADY_IMPORTED' WHEN chars < 40 THEN 'LOW_QUALITY' WHEN id > min(id) OVER (PARTITION BY key) THEN 'DUPLICATE_REVIEW' ELSE 'CLEANED' END AS status FROM r""",
    "documents_quality": f"""SELECT doc_id, round(0.3::DOUBLE + 0.25::DOUBLE * least(1.0::DOUBLE, length(coalesce(text, '')) / 500.0::DOUBLE) + CASE WHEN regexp_matches(coalesce(text, ''), '职责|要求|任职|负责|responsib|require') THEN 0.2::DOUBLE ELSE 0.05::DOUBLE END
      + CASE WHEN doc_id IN (SELECT doc_id FROM {_MENTION}) THEN 0.25::DOUBLE ELSE 0.05::DOUBLE END, 6) AS quality FROM documents""",
    "similar_token_sets": f"""WITH s AS (SELECT min(id) AS id, t FROM (SELECT id, {_TOK.replace('(text)', '(title)')} AS t FROM dataset_job_raw) WHERE len(t) > 0 GROUP BY t)
      SELECT id_a, id_b, round(i / (na + nb - i), 6) AS similarity FROM (SELECT a.id AS id_a, b.id AS id_b, len(a.t) AS na, len(b.t) AS nb, len(list_intersect(a.t, b.t)) AS i FROM s a JOIN s b ON a.id < b.id AND list_has_any(a.t, b.t)) WHERE i / (na + nb - i) >= 0.6""",
    "lowered_hashes": f"SELECT doc_id, {_KEY} AS hash FROM documents",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "event_sessions": """SELECT user_id, session, count(*) AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session
      FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR date_sub('second', lag(ts) OVER w, ts) > 1800 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY 1, 2""",
    "event_momentum": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) FILTER (hour(ts) < 12) AS am, count(*) FILTER (hour(ts) >= 12) AS pm, round(least(greatest(0.5::DOUBLE + 0.5::DOUBLE * (count(*) FILTER (hour(ts) >= 12) - count(*) FILTER (hour(ts) < 12)) / count(*), 0), 1), 6) AS momentum FROM events GROUP BY 1, 2",
    "event_properties": "SELECT event_type, count(v) AS stated, round(sum(v), 4) AS total, max(v) AS largest FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events) GROUP BY 1",
}
SQL = all_blank_trim(SQL)


def discovery_titles(s: SparkSession, d: str) -> DataFrame:
    """Titles of postings cleaned for discovery and whether they name a role."""
    cleaned = table(s, d, "raw_job").select("id", clean_title(F.col("title")).alias("cleaned"))
    return cleaned.select("id", "cleaned", plausible_title(F.col("cleaned")).alias("plausible"))


def parsed_profiles(s: SparkSession, d: str) -> DataFrame:
    return parse_profiles(_resumes(s, d), "doc_id", "text")


def answered_question(s: SparkSession, d: str) -> DataFrame:
    """The first plan of a question, run."""
    return run_plan(plans_for("2025年哪些城市的岗位最多，前5名")[0], table(s, d, "governed"), table(s, d, "governed_skill"))


QUERIES |= {"discovery_titles": discovery_titles, "parsed_profiles": parsed_profiles, "answered_question": answered_question}
SQL["answered_question"] = f"""SELECT nullif(trim(city, ' '), '') AS value, count(DISTINCT coalesce(nullif(trim(duplicate_group, ' '), ''), 'U-' || CAST(raw_job_id AS VARCHAR))) AS job_count, count(DISTINCT nullif(trim(company, ' '), '')) AS company_count,
  round(avg(nullif((CAST(salary_min AS DOUBLE) + CAST(salary_max AS DOUBLE)) / 2, 0)), 4) AS avg_salary FROM zhitu_governed_job WHERE {OK} AND published_year = 2025 AND nullif(trim(city, ' '), '') IS NOT NULL GROUP BY 1 ORDER BY job_count DESC, value LIMIT 5"""
