"""Extraction, evidence, review and lookup queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.functions import evidence as V
from jobweave.functions.measures import analysable, double
from jobweave.operators import extraction as X
from jobweave.operators import forecast as P
from jobweave.operators import governance as G
from jobweave.operators import insight as I
from jobweave.operators import listings as L
from jobweave.operators import records as R
from jobweave.plans.analysis_queries import _TY
from jobweave.plans.analysis_queries import SQL as ANALYSES
from jobweave.plans.governance_queries import _MD5, _SP, _case, _re2
from jobweave.plans.market_queries import OK
from jobweave.plans.people_queries import _NEEDS as NEEDS
from jobweave.plans.people_queries import _mentions, _names, _needs
from jobweave.plans.sql import all_blank_trim
from jobweave.sources.tables import table

AS_OF = "2026-06-30"
EVIDENCE_KEYS = ("title_standard", "tech_stack", "level_name", "description_clean")


def text_forms(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(s, d, "raw_job").select(
        "id", V.match_form(c("title")).alias("match"), V.evidence_form(c("title"), folded=False).alias("evidence"), V.abbreviated(c("company"), 12).alias("short"),
        V.clipped(c("description"), 60).alias("clip"), I.role_name(c("title")).alias("role"), F.sha2(V.demo_clean(c("description")), 256).alias("cleaned"), F.sha2(V.edited_template(c("description")), 256).alias("template"),
    )


def anchored_evidence(s: SparkSession, d: str) -> DataFrame:
    """Whether the evidence of each relation stands in its posting's description."""
    texts = table(s, d, "governed").select("raw_job_id", "description_clean")
    rows = table(s, d, "governed_skill").where("evidence_text is not null").select("id", "raw_job_id", "evidence_text").join(texts, "raw_job_id")
    return rows.select("id", V.anchored(V.evidence_form(F.col("description_clean"), folded=False), V.evidence_form(F.col("evidence_text"), folded=False)).alias("anchored"))


def grounded_roles(s: SparkSession, d: str) -> DataFrame:
    """How many postings of a listed role hold its stated responsibilities."""
    roles = table(s, d, "job_role").select(F.trim("role_name").alias("role"), "responsibilities")
    rows = table(s, d, "governed").select(F.trim("title_standard").alias("role"), "description_clean").join(F.broadcast(roles), "role")  # the reference list
    return I.grounded_share(rows, "role", F.col("responsibilities"), F.col("description_clean"))


def head_tails(s: SparkSession, d: str) -> DataFrame:
    text = V.head_and_tail(F.col("text"), 400)
    return table(s, d, "documents").select("doc_id", F.length(text).alias("chars"), F.sha2(text, 256).alias("hash"))


def json_lists(s: SparkSession, d: str) -> DataFrame:
    """Aliases of skills as lists and back, and out of a fenced answer."""
    fenced = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("canonical_name").alias("name"))), F.lit("\n```"))
    items = V.json_items(F.col("aliases"))
    return table(s, d, "skill").select("id", F.size(items).alias("items"), F.to_json(items).alias("written"), F.get_json_object(V.fenced_json(fenced), "$.name").alias("name"))


def stable_ids(s: SparkSession, d: str) -> DataFrame:
    keys = table(s, d, "governed").where("title_standard is not null").select("title_standard", "tech_stack", "level_name").distinct()
    return keys.select(V.stable_key(*[F.col(c) for c in keys.columns]).alias("role_key"), V.stable_id("role", F.concat_ws("|", *keys.columns)).alias("role_id"))


def freshness_by_source(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "governed").where(analysable()).select("source_name", V.freshness(F.col("published_at"), F.to_date(F.lit(AS_OF))).alias("f"))
    return rows.groupBy("source_name").agg(F.count("f").alias("dated"), F.round(F.avg("f"), 6).alias("freshness"))


def running_scores(s: SparkSession, d: str) -> DataFrame:
    """The running score over the last 14 events of each user: views raise it by their value, others lower it."""
    last = L.last_per_key(table(s, d, "events").select("event_id", "user_id", "ts", "event_type", "value"), "user_id", "ts", "event_id", 14)
    change = F.round(F.when(F.col("event_type") == "view", F.col("value")).otherwise(-F.col("value")), 4)
    ordered = last.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("place", change.alias("x")))).alias("l"))  # at most 14
    scores = V.clamped_run(F.col("l.x"))
    return ordered.select("user_id", F.size(scores).alias("steps"), F.element_at(scores, -1).alias("score"), F.array_min(scores).alias("lowest"), F.array_max(scores).alias("highest"))


def answer_confidences(s: SparkSession, d: str) -> DataFrame:
    """How sure an answer about each role would be: up to twelve postings as evidence, duplicates as warnings."""
    per = table(s, d, "governed").where(F.trim("title_standard") != "").groupBy(F.trim("title_standard").alias("role")).agg(F.count_if(analysable()).alias("n"), F.count_if(F.col("governance_status") == "DUPLICATE_REVIEW").alias("warnings"))
    return per.select("role", V.answer_confidence(F.least(F.lit(12), "n"), F.lit(False), F.col("warnings")).alias("confidence"))


def opportunities(s: SparkSession, d: str) -> DataFrame:
    """Discovered roles with their risk and opportunity."""
    rows = P.discovered(P.title_years(table(s, d, "governed")))
    risk = P.trust_risk(F.col("n"), F.lit(2), F.col("confidence"), F.lit(False))
    rows = rows.withColumn("risk", F.round(risk, 4))
    return rows.select("year", "place", "risk", V.risk_level(F.col("risk")).alias("level"), V.opportunity(F.col("confidence"), F.col("novelty"), F.col("growth"), F.col("risk")).alias("opportunity"))


def evidence_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows as evidence: listed columns only, nothing blank, texts clipped at 720 characters."""
    told = [F.when(F.trim(c) != "", F.concat(F.lit(f"{c}="), F.substring(c, 1, 720))) for c in EVIDENCE_KEYS]
    return table(s, d, "governed").select("raw_job_id", F.concat_ws("\n", *told).alias("evidence"))


def canonical_skills(s: SparkSession, d: str) -> DataFrame:
    """Every spelling of the relation with its canonical name."""
    names = table(s, d, "skill").select(F.col("canonical_name").alias("name"), F.col("canonical_name").alias("alias"), F.col("id").alias("rank"))
    return I.canonical_names(table(s, d, "governed_skill"), "skill_name", names)


def _found(s: SparkSession, d: str) -> DataFrame:
    named = table(s, d, "skill").select(F.col("id").alias("skill_id"), F.col("canonical_name").alias("skill"))
    jobs = table(s, d, "governed").select("raw_job_id", "description_clean")
    return X.skill_mentions(jobs, _names(s, d), "raw_job_id", "description_clean").join(named, "skill_id").select("raw_job_id", "skill")


def posting_extractions(s: SparkSession, d: str) -> DataFrame:
    postings = table(s, d, "governed").select("raw_job_id", "title_raw", "description_clean")
    got = I.extract_postings(postings, _found(s, d), "raw_job_id", "title_raw", "description_clean")
    return got.select("raw_job_id", "role", "stack", "level", *[F.array_join(c, "|").alias(c) for c in ("duties", "scenarios", "required", "bonus")], "coverage", "confidence")


def evidence_gate(s: SparkSession, d: str) -> DataFrame:
    """Relations of each posting that its description bears out, and those it does not."""
    claims = table(s, d, "governed_skill").where("skill_name is not null").select("raw_job_id", F.col("skill_name").alias("skill"))
    return I.gate(claims, _found(s, d), ["raw_job_id", "skill"])


def _published(s: SparkSession, d: str) -> DataFrame:
    return R.published(table(s, d, "job_role"), _needs(s, d), table(s, d, "skill"))


def role_details(s: SparkSession, d: str) -> DataFrame:
    return R.best_evidence(_published(s, d), table(s, d, "governed_skill"), table(s, d, "governed"))


def posting_roles(s: SparkSession, d: str) -> DataFrame:
    """Raw postings with the listed role of exactly their title, where there is one."""
    roles = table(s, d, "job_role").select(F.col("id").alias("role_id"), "role_name")
    return table(s, d, "raw_job").select("id", "title").join(F.broadcast(roles), F.col("title") == F.col("role_name"), "left").select("id", "role_id")  # the reference list


def role_listing(s: SparkSession, d: str) -> DataFrame:
    order = [F.desc_nulls_last("confidence"), F.desc("updated_at"), F.asc("id")]
    return table(s, d, "job_role").where("status = 'PUBLISHED'").orderBy(*order).limit(500).select("id", "role_name", "confidence")


def holdout_listing(s: SparkSession, d: str) -> DataFrame:
    held = G.holdout_sample(table(s, d, "raw_job"), 2026, 100, "md5")
    return table(s, d, "raw_job").select("id", "title", "company").join(F.broadcast(held), F.col("id") == F.col("raw_id")).select("id", "title", "company", "holdout_year")  # at most 100 rows


def source_status(s: SparkSession, d: str) -> DataFrame:
    runs = table(s, d, "governed").select("source_name", "governance_status", "governed_at", "raw_job_id")
    return R.status_of_each(table(s, d, "source_trust"), "source_name", runs, "source_name", "governance_status", [F.col("governed_at"), F.col("raw_job_id")])


def additive_counts(s: SparkSession, d: str) -> DataFrame:
    """Counts of relations per skill out of two batches that are merged."""
    rows = table(s, d, "governed_skill").where("skill_name is not null").select("skill_name", F.pmod("raw_job_id", F.lit(2)).alias("batch"), F.lit(1).alias("relations"), F.round(double("confidence") * 1_000_000).cast("long").alias("weight"), F.col("raw_job_id").alias("first_id"), F.col("raw_job_id").alias("last_id"))
    part = lambda k: R.added(rows.where(F.col("batch") == k).drop("batch"), rows.where("false").drop("batch"), ["skill_name"], ["relations", "weight"], ["first_id"], ["last_id"])
    return R.added(part(0), part(1), ["skill_name"], ["relations", "weight"], ["first_id"], ["last_id"])


def upserted_issues(s: SparkSession, d: str) -> DataFrame:
    """Issues of governed rows where those of a fresh pass come in over stored ones."""
    rows = table(s, d, "governed").select("raw_job_id", "skill_count", "published_year", F.length(F.coalesce("description_clean", F.lit(""))).alias("chars"))
    short = lambda below, severity: rows.where(F.col("chars") < below).select("raw_job_id", F.lit("LOW_CONTENT").alias("issue_type"), F.lit("description").alias("field_name"), F.lit(severity).alias("severity"))
    return R.upsert(short(200, "LOW"), short(80, "HIGH"), ["raw_job_id", "issue_type", "field_name"], ["severity"])


def replaced_roles(s: SparkSession, d: str) -> DataFrame:
    """Listed roles where those under review give way to newly discovered ones."""
    found = P.discovered(P.title_years(table(s, d, "governed"))).select(F.lit(None).cast("long").alias("id"), F.col("shown").alias("role_name"), F.lit("REVIEWING").alias("status"))
    return R.replaced(table(s, d, "job_role").select("id", "role_name", "status"), found, "status", "REVIEWING")


def appended_candidates(s: SparkSession, d: str) -> DataFrame:
    """Forecast candidates with the figures they rest on, as a run appends them."""
    years = P.title_years(table(s, d, "governed"))
    return R.appended(P.candidates(years), [F.lit("forecast"), F.col("year").cast("string")], ["title", "n", "h1", "h2"], "year", "place")


def reviewed_roles(s: SparkSession, d: str) -> DataFrame:
    """Listed roles after decisions: a level or stack that most postings state patches the list, sure ones are approved."""
    decisions = table(s, d, "governed").where("manual_modified = 1").join(table(s, d, "job_role").select("id", F.trim("role_name").alias("r")), F.trim("title_standard") == F.col("r")).select(
        "id", F.when(F.col("valid_for_analysis") == 1, "APPROVE").otherwise("REJECT").alias("decision"), "tech_stack", "level_name", "governed_at", "raw_job_id"
    )
    return R.reviewed(table(s, d, "job_role"), decisions, "id", ["tech_stack", "level_name"], "status", ["governed_at", "raw_job_id"])


def edited_relation(s: SparkSession, d: str) -> DataFrame:
    """The relation after deletions of what is unsure and additions out of the texts."""
    loaded = table(s, d, "governed_skill").where("skill_name is not null").select("raw_job_id", F.col("skill_name").alias("skill"), "confidence", "created_at", "id")
    gone = loaded.where("confidence < 0.75").select("raw_job_id", "skill", F.lit("DELETE").alias("action"), F.lit(1).alias("turn"))
    come = _found(s, d).select("raw_job_id", "skill", F.lit("ADD").alias("action"), F.lit(2).alias("turn"))
    return R.edited_skills(loaded, gone.unionByName(come), ["raw_job_id", "skill"], ["turn"])


def emerged_in_holdout(s: SparkSession, d: str) -> DataFrame:
    """Titles that rose in 2026 as the held-out rows alone tell it."""
    jobs = table(s, d, "governed")
    held = G.holdout_sample(table(s, d, "raw_job"), 2026, 1000, "md5").select(F.col("raw_id").alias("raw_job_id"))
    train = P.title_years(jobs.where("published_year = 2025"))
    tested = P.title_years(jobs.where("published_year = 2026").join(F.broadcast(held), "raw_job_id", "left_semi"))  # at most 1000 rows
    return P.emerged_in_sample(train, tested, P.title_years(jobs.where("published_year = 2026")))


QUERIES = {
    f.__name__: f
    for f in (
        text_forms, anchored_evidence, grounded_roles, head_tails, json_lists, stable_ids, freshness_by_source, running_scores, answer_confidences, opportunities, evidence_rows, canonical_skills,
        posting_extractions, evidence_gate, role_details, posting_roles, role_listing, holdout_listing, source_status, additive_counts, upserted_issues, replaced_roles, appended_candidates,
        reviewed_roles, edited_relation, emerged_in_holdout,
    )
} | {
    "question_terms": lambda s, d: table(s, d, "eval_item").select("item_id", F.array_join(V.question_terms(F.col("text")), "|").alias("terms")),
    "listed_values": lambda s, d: table(s, d, "raw_job").where("industry is not null").select("id", F.array_join(V.listed(F.col("industry"), 8), "|").alias("items")),
    "percentages": lambda s, d: table(s, d, "governed_skill").where("confidence is not null").select("id", V.percent(double("confidence")).alias("share"), V.points(F.round((double("confidence") - 0.8) * 100, 2)).alias("above")),
    "plausible_skills": lambda s, d: table(s, d, "governed_skill").where("skill_name is not null").select("skill_name").distinct().select("skill_name", I.plausible_skill(F.col("skill_name")).alias("plausible")),
    "published_relations": _published,
    "readiness": lambda s, d: R.readiness(table(s, d, "raw_job"), table(s, d, "governed"), 1000),
    "daily_trend": lambda s, d: R.daily_trend(table(s, d, "governed"), F.col("published_at")).withColumn("day", F.col("day").cast("string")),
}

_C = " \\t\\n\\x0b\\f\\r"  # white space within a class of characters
_S = f"[{_C}]"
_R = lambda x, p, r="": f"regexp_replace({x}, '{_re2(p)}', '{r}', 'g')"
_MATCH = lambda x: _R(f"lower(coalesce({x}, ''))", rf"[{_C}_\-·/]+")
_EVID = lambda x: _R(f"lower(coalesce({x}, ''))", rf"[{_C}_\-./|｜、，,;；:：()（）]+")
_CTRL = lambda x: f"regexp_replace({x}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"
_CLIP = lambda x, n: f"CASE WHEN length({_SP(x)}) <= {n} THEN {_SP(x)} ELSE {_R(f'substring({_SP(x)}, 1, {n})', '[，,；;、' + _C + ']+$')} || '…' END"
_ROLE = lambda x: f"coalesce(nullif({_SP(_R(_R(f'coalesce({x}, $$$$)', '[（(].*?[）)]', ' '), I.ROLE_NOISE, ' '))}, ''), '未命名岗位')"
_DEMO = _R(_R("coalesce(description, $$$$)", V.HTML, " "), V.SHORT_ADVERT, " ")
_DEMO = _CTRL(_R(_R(_R(_DEMO, r"[\t\r]+", " "), "[ ]{2,}", " "), r"\n{3,}", "' || chr(10) || chr(10) || '"))
_EDIT = _SP(_R(_R("lower(coalesce(description, $$$$))", r"[0-9]+(?:\.[0-9]+)?", "#"), r"[^a-z0-9\x{4e00}-\x{9fff}+#.]", " "))
_TOKENS = lambda x: rf"list_distinct(list_filter(string_split(regexp_replace({_SP(f'lower({x})')}, '[^\p{{L}}\p{{N}}+#.]+', ' ', 'g'), ' '), lambda t: length(t) > 1))"
_PHRASE = lambda x: _SP(_R(f"coalesce({x}, '')", rf"^[：:、,，\-{_C}]+"))
_RUN3 = lambda x: f"list_transform(range(1, length({x}) - 1), lambda k: substring({x}, k, 3))"
_PLAUSIBLE = lambda x: f"""(length(trim({x}, ' ')) BETWEEN 1 AND 25 AND {_R(f"trim({x}, ' ')", r"\s+")} NOT IN ('{"', '".join(I.COURSES)}') AND NOT (regexp_matches(trim({x}, ' '), '^[A-Za-z]$') AND upper(trim({x}, ' ')) <> 'C')
  AND NOT regexp_matches(trim({x}, ' '), '{I.NO_SKILL_END}') AND NOT regexp_matches(trim({x}, ' '), '{I.NO_SKILL}'))"""  # noqa: E731
_FOUND = f"(SELECT DISTINCT m.raw_job_id, k.canonical_name AS skill FROM {_mentions('zhitu_governed_job', 'raw_job_id', 'description_clean')} m JOIN skill k ON m.skill_id = k.id)"
_WORDS = lambda words: "|".join(w.replace(" ", "") for w in words)
_NEAR = "substring(t, greatest(1, pos - 60), pos + length(w) + 60 - greatest(1, pos - 60))"
_EXTRACT = f"""f AS {_FOUND}, g AS (SELECT raw_job_id, coalesce(description_clean, '') AS x, {_ROLE('title_raw')} AS role FROM zhitu_governed_job),
pl AS (SELECT f.raw_job_id, f.skill, {_MATCH('g.x')} AS t, {_MATCH('f.skill')} AS w, strpos({_MATCH('g.x')}, {_MATCH('f.skill')}) AS pos FROM f JOIN g USING (raw_job_id) WHERE {_PLAUSIBLE('f.skill')}),
mk AS (SELECT raw_job_id, skill, pos > 0 AND regexp_matches({_NEAR}, '{_WORDS(I.BONUS)}') AS bonus FROM pl),
bk AS (SELECT raw_job_id, skill, CASE WHEN bonus AND max(CASE WHEN bonus THEN 0 ELSE 1 END) OVER (PARTITION BY raw_job_id) = 1 THEN 'BONUS' ELSE 'REQUIRED' END AS part FROM mk),
bs AS (SELECT raw_job_id, list_sort(list(skill) FILTER (part = 'REQUIRED')) AS required, list_sort(list(skill) FILTER (part = 'BONUS')) AS bonus FROM bk GROUP BY 1),
ev AS (SELECT raw_job_id, count(*) AS evidence FROM f GROUP BY 1),
ss AS (SELECT raw_job_id, role, x, list_transform(string_split_regex(regexp_replace(replace(x, chr(13), chr(10)), '\\.{_S}+', '.' || chr(10), 'g'), '[。；;\\n]'), lambda p: {_PHRASE('p')}) AS parts FROM g),
dt AS (SELECT raw_job_id, role, x, list_filter(parts, lambda p: length(p) BETWEEN 8 AND 120 AND regexp_matches({_MATCH('p')}, '{_WORDS(I.DUTIES)}') AND NOT regexp_matches({_R('p', r"\s+")}, '^(?:{"|".join(I.REQUIREMENTS)})')) AS kept FROM ss),
du AS (SELECT raw_job_id, role, x, list_slice(list_filter(kept, lambda p, k: list_position(kept, p) = k), 1, 6) AS kept, {_case("lower(role || chr(10) || x)", I.STACKS, "'人工智能'")} AS stack, {_case("lower(role || chr(10) || x)", I.LEVELS, "'初级'")} AS level, {_MATCH('x')} AS low FROM dt),
sc AS (SELECT *, list_filter([{", ".join(f"CASE WHEN regexp_matches(low, '{'|'.join(w.lower() for w in words)}') THEN '{name}' END" for name, words in I.SCENARIOS)}], lambda v: v IS NOT NULL) AS told FROM du)"""
_CHANGED = "list_transform(range(1, len(xs) + 1), lambda k: list_reduce(list_prepend(50.0::DOUBLE, xs[1:k]), lambda a, x: round(greatest(12.0::DOUBLE, least(88.0::DOUBLE, a + x * 1.6::DOUBLE)), 6)))"
_PUB = f"SELECT j.id AS role_id, n.role, k.id AS skill_id, n.skill_name AS skill, n.kind, n.importance FROM ({NEEDS}) n JOIN job_role j ON trim(j.role_name) = n.role AND j.status = 'PUBLISHED' JOIN skill k ON k.canonical_name = n.skill_name"
_ID3 = "md5('role' || chr(0) || concat_ws('|', title_standard, tech_stack, level_name))"
_HT = _CTRL("coalesce(text, $$$$)")
_HT = f"CASE WHEN length({_HT}) <= 400 THEN {_HT} ELSE substring({_HT}, 1, 288) || chr(10) || chr(10) || '{V.OMITTED.strip()}' || chr(10) || chr(10) || right({_HT}, 112) END"
_ITEMS = _SP(_R(_R("industry", "[\\[\\]{}\"']", " "), V.LIST_LABEL, " "))
_LATIN = f"list_filter(list_transform(regexp_extract_all(text, '{V.LATIN_TERM}'), lambda t: lower(t)), lambda t: t NOT IN ('agent', 'rag', 'api'))"
_DISTINCT = lambda x: f"list_filter({x}, lambda v, k: list_position({x}, v) = k)"
_HANS = f"list_filter(string_split({_R(_R(_R('text', V.LATIN_TERM, ' '), V.ASKING, ' '), '[^' + chr(92) + 'p{Han}]+', ' ')}, ' '), lambda r: length(r) BETWEEN 2 AND 12)"
_HELD = f"SELECT raw_id FROM ({_MD5.replace('LIMIT 100', 'LIMIT 1000')})"
_YEAR = lambda where: _TY.replace("FROM zhitu_governed_job WHERE", f"FROM zhitu_governed_job WHERE {where} AND")
SQL = {
    "text_forms": f"SELECT id, {_MATCH('title')} AS match, {_EVID('title')} AS evidence, substring({_SP('coalesce(company, $$$$)')}, 1, 12) AS short, {_CLIP('coalesce(description, $$$$)', 60)} AS clip, {_ROLE('title')} AS role, sha256({_DEMO}) AS cleaned, sha256({_EDIT}) AS template FROM dataset_job_raw",
    "anchored_evidence": f"""WITH r AS (SELECT s.id, {_EVID('g.description_clean')} AS w, {_EVID('s.evidence_text')} AS p FROM zhitu_governed_job_skill s JOIN zhitu_governed_job g USING (raw_job_id) WHERE s.evidence_text IS NOT NULL),
      z AS (SELECT *, least(24, length(p)) AS n FROM r)
      SELECT id, length(p) >= 6 AND (contains(w, p) OR len(list_filter(range(1, greatest(length(p) - n + 1, 1) + 1, greatest(6, n // 2)), lambda k: length(substring(p, k, n)) >= 8 AND contains(w, substring(p, k, n)))) > 0) AS anchored FROM z""",
    "grounded_roles": f"""WITH r AS (SELECT trim(g.title_standard) AS role, coalesce(g.description_clean, '') AS x, {_PHRASE('j.responsibilities')} AS c FROM zhitu_governed_job g JOIN job_role j ON trim(j.role_name) = trim(g.title_standard)),
      t AS (SELECT *, {_MATCH('c')} AS short, {_MATCH('x')} AS whole, {_TOKENS('c')} AS words, {_TOKENS('x')} AS others FROM r)
      SELECT role, count(*) AS phrases, count(*) FILTER (length(c) BETWEEN 4 AND 80 AND (length(short) >= 6 AND contains(whole, short) OR len(words) > 0 AND len(list_intersect(words, others)) >= 0.55 * len(words))) AS grounded FROM t GROUP BY 1""",
    "head_tails": f"SELECT doc_id, length({_HT}) AS chars, sha256({_HT}) AS hash FROM documents",
    "json_lists": """SELECT id, CASE WHEN json_valid(aliases) AND json_type(CASE WHEN json_valid(aliases) THEN aliases END) = 'ARRAY' THEN json_array_length(aliases) ELSE 0 END AS items,
      CASE WHEN json_valid(aliases) AND json_type(CASE WHEN json_valid(aliases) THEN aliases END) = 'ARRAY' THEN CAST(json(aliases) AS VARCHAR) ELSE '[]' END AS written, canonical_name AS name FROM skill""",
    "stable_ids": f"""SELECT sha256(concat_ws(chr(31), title_standard, tech_stack, level_name)) AS role_key, 'role-' || substring({_ID3}, 1, 8) || '-' || substring({_ID3}, 9, 4) || '-3' || substring({_ID3}, 14, 3) || '-' || translate(substring({_ID3}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substring({_ID3}, 18, 3) || '-' || substring({_ID3}, 21, 12) AS role_id
      FROM (SELECT DISTINCT title_standard, tech_stack, level_name FROM zhitu_governed_job WHERE title_standard IS NOT NULL)""",
    "freshness_by_source": f"SELECT source_name, count(published_at) AS dated, round(avg(CASE WHEN published_at IS NOT NULL THEN greatest(0.25::DOUBLE, 1 - abs(date_diff('day', published_at, DATE '{AS_OF}')) / 730.0::DOUBLE) END), 6) AS freshness FROM zhitu_governed_job WHERE {OK} GROUP BY 1",
    "running_scores": f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events), x AS (SELECT user_id, list(round(CASE WHEN event_type = 'view' THEN value ELSE -value END, 4) ORDER BY back DESC) AS xs FROM l WHERE back <= 14 GROUP BY 1),
      r AS (SELECT user_id, {_CHANGED} AS scores FROM x) SELECT user_id, len(scores) AS steps, scores[-1] AS score, list_min(scores) AS lowest, list_max(scores) AS highest FROM r""",
    "answer_confidences": f"""SELECT role, CASE WHEN n = 0 THEN 0.25::DOUBLE ELSE least(0.94::DOUBLE, round(0.58::DOUBLE + CASE WHEN n >= 4 THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN warnings = 0 THEN 0.04::DOUBLE ELSE 0 END, 6)) END AS confidence FROM
      (SELECT trim(title_standard) AS role, least(12, count(*) FILTER ({OK})) AS n, count(*) FILTER (governance_status = 'DUPLICATE_REVIEW') AS warnings FROM zhitu_governed_job WHERE trim(title_standard) <> '' GROUP BY 1)""",
    "opportunities": f"""WITH r AS (SELECT *, round(least(greatest(0.55::DOUBLE * (1 - confidence) + CASE WHEN n < 3 THEN 0.15::DOUBLE ELSE 0 END, 0), 1), 4) AS risk FROM ({ANALYSES['discovered_roles']}))
      SELECT year, place, risk, CASE WHEN risk >= 0.35 THEN 'HIGH' WHEN risk >= 0.18 THEN 'REVIEW' ELSE 'LOW' END AS level, least(99, greatest(0, CAST(round((confidence * 0.36::DOUBLE + novelty * 0.28::DOUBLE + growth * 0.24::DOUBLE + (1 - risk) * 0.12::DOUBLE) * 100) AS INTEGER))) AS opportunity FROM r""",
    "evidence_rows": "SELECT raw_job_id, concat_ws(chr(10), " + ", ".join(f"CASE WHEN trim({c}) <> '' THEN '{c}=' || substring({c}, 1, 720) END" for c in EVIDENCE_KEYS) + ") AS evidence FROM zhitu_governed_job",
    "canonical_skills": f"""WITH v AS (SELECT DISTINCT skill_name AS value, {_R("lower(skill_name)", "[" + _C + "_" + chr(92) + "-]+")} AS form FROM zhitu_governed_job_skill WHERE trim(skill_name) <> ''),
      k AS (SELECT canonical_name AS name, {_R("lower(canonical_name)", "[" + _C + "_" + chr(92) + "-]+")} AS alias, id AS rank FROM skill WHERE canonical_name IS NOT NULL),
      e AS (SELECT value, arg_min(name, (rank, name, alias)) AS equal FROM v JOIN k ON v.form = k.alias WHERE alias <> '' GROUP BY 1),
      p AS (SELECT value, arg_min(name, (rank, name, alias)) AS part FROM v JOIN k ON length(form) >= 3 AND length(alias) >= 3 AND (contains(form, alias) OR contains(alias, form)) WHERE value NOT IN (SELECT value FROM e) GROUP BY 1)
      SELECT v.value AS skill_name, coalesce(e.equal, p.part, trim(v.value)) AS canonical, CASE WHEN e.equal IS NOT NULL THEN 'equal' WHEN p.part IS NOT NULL THEN 'part' ELSE 'own' END AS how FROM v LEFT JOIN e USING (value) LEFT JOIN p USING (value)""",
    "posting_extractions": f"""WITH {_EXTRACT}, r AS (SELECT sc.raw_job_id, role, stack, level, CASE WHEN len(kept) > 0 THEN kept ELSE ['完成' || role || '相关系统设计、开发、优化与交付'] END AS duties, CASE WHEN len(told) > 0 THEN list_slice(told, 1, 6) ELSE [stack || '业务场景'] END AS scenarios,
      coalesce(required, []) AS required, coalesce(bonus, []) AS bonus, coalesce(evidence, 0) AS evidence FROM sc LEFT JOIN bs USING (raw_job_id) LEFT JOIN ev USING (raw_job_id)),
      c AS (SELECT *, CASE WHEN evidence = 0 THEN 0.0::DOUBLE ELSE round((len(required) + len(bonus)) / evidence, 3) END AS coverage FROM r)
      SELECT raw_job_id, role, stack, level, array_to_string(duties, '|') AS duties, array_to_string(scenarios, '|') AS scenarios, array_to_string(required, '|') AS required, array_to_string(bonus, '|') AS bonus, coverage,
      round(greatest(0.55::DOUBLE, least(0.99::DOUBLE, 0.72::DOUBLE + least(0.14::DOUBLE, len(required) * 0.014::DOUBLE) + CASE WHEN len(duties) >= 2 THEN 0.06::DOUBLE ELSE 0 END + least(0.06::DOUBLE, coverage * 0.06::DOUBLE))) + 1e-9, 3) AS confidence FROM c""",
    "evidence_gate": f"""WITH f AS {_FOUND}, c AS (SELECT DISTINCT raw_job_id, skill_name AS skill FROM zhitu_governed_job_skill WHERE skill_name IS NOT NULL)
      SELECT raw_job_id, count(f.skill) AS accepted, count(*) - count(f.skill) AS blocked FROM c LEFT JOIN f USING (raw_job_id, skill) GROUP BY 1""",
    "role_details": f"""WITH p AS ({_PUB}) SELECT role, skill, id AS evidence_id, place FROM (SELECT trim(g.title_standard) AS role, s.skill_name AS skill, s.id, row_number() OVER (PARTITION BY trim(g.title_standard), s.skill_name ORDER BY CAST(s.confidence AS DOUBLE) DESC NULLS LAST, s.id) AS place
      FROM zhitu_governed_job_skill s JOIN zhitu_governed_job g USING (raw_job_id) WHERE s.evidence_text IS NOT NULL AND (trim(g.title_standard), s.skill_name) IN (SELECT (role, skill) FROM p)) WHERE place <= 8""",
    "posting_roles": "SELECT r.id, j.id AS role_id FROM dataset_job_raw r LEFT JOIN job_role j ON r.title = j.role_name",
    "role_listing": "SELECT id, role_name, confidence FROM job_role WHERE status = 'PUBLISHED' ORDER BY confidence DESC NULLS LAST, updated_at DESC, id LIMIT 500",
    "holdout_listing": f"SELECT id, title, company, holdout_year FROM dataset_job_raw JOIN ({_MD5}) ON id = raw_id",
    "source_status": """WITH r AS (SELECT lower(nullif(trim(source_name), '')) AS k, arg_max(governance_status, (governed_at, raw_job_id)) AS s, count(*) AS runs FROM zhitu_governed_job GROUP BY 1)
      SELECT DISTINCT t.source_name AS key, coalesce(s, 'READY') AS status, coalesce(runs, 0) AS runs FROM source_trust t LEFT JOIN r ON lower(nullif(trim(t.source_name), '')) = r.k""",
    "additive_counts": "SELECT skill_name, count(*) AS relations, sum(CAST(round(CAST(confidence AS DOUBLE) * 1000000) AS BIGINT)) AS weight, min(raw_job_id) AS first_id, max(raw_job_id) AS last_id FROM zhitu_governed_job_skill WHERE skill_name IS NOT NULL GROUP BY 1",
    "upserted_issues": "SELECT raw_job_id, 'LOW_CONTENT' AS issue_type, 'description' AS field_name, CASE WHEN length(coalesce(description_clean, '')) < 80 THEN 'HIGH' ELSE 'LOW' END AS severity FROM zhitu_governed_job WHERE length(coalesce(description_clean, '')) < 200",
    "replaced_roles": f"SELECT id, role_name, status FROM job_role WHERE status IS DISTINCT FROM 'REVIEWING' UNION ALL SELECT NULL, shown, 'REVIEWING' FROM ({ANALYSES['discovered_roles']})",
    "appended_candidates": f"""SELECT sha256(concat_ws(chr(31), 'forecast', CAST(c.year AS VARCHAR))) AS run_id, c.year, c.place, '{{"title":' || to_json(c.title) || ',"n":' || c.n || ',"h1":' || y.h1 || ',"h2":' || y.h2 || '}}' AS evidence_json
      FROM ({ANALYSES['forecast_candidates']}) c JOIN ({_TY}) y ON y.year = c.year AND y.title = c.title""",
    "reviewed_roles": """WITH d AS (SELECT j.id, arg_max(CASE WHEN valid_for_analysis = 1 THEN 'APPROVE' ELSE 'REJECT' END, (governed_at, raw_job_id)) AS decision, max_by({'t': g.tech_stack, 'l': g.level_name}, (governed_at, raw_job_id)) AS v FROM zhitu_governed_job g JOIN job_role j ON trim(g.title_standard) = trim(j.role_name) WHERE manual_modified = 1 GROUP BY 1),
      a AS (SELECT j.*, d.decision, coalesce(d.v.t, j.tech_stack) AS t, coalesce(d.v.l, j.level_name) AS l FROM job_role j LEFT JOIN d USING (id))
      SELECT id, t AS tech_stack, l AS level_name, CASE WHEN decision = 'APPROVE' THEN 'PUBLISHED' WHEN decision = 'REJECT' THEN 'REJECTED' ELSE status END AS status, CASE WHEN t IS DISTINCT FROM tech_stack THEN 1 ELSE 0 END + CASE WHEN l IS DISTINCT FROM level_name THEN 1 ELSE 0 END AS changed FROM a""",
    "edited_relation": f"""WITH f AS {_FOUND}, o AS (SELECT DISTINCT raw_job_id, skill_name AS skill FROM zhitu_governed_job_skill WHERE skill_name IS NOT NULL), g AS (SELECT DISTINCT raw_job_id, skill_name AS skill FROM zhitu_governed_job_skill WHERE confidence < 0.75 AND skill_name IS NOT NULL)
      SELECT raw_job_id, skill, 'LOADED' AS origin FROM o WHERE (raw_job_id, skill) IN (SELECT (raw_job_id, skill) FROM f) OR (raw_job_id, skill) NOT IN (SELECT (raw_job_id, skill) FROM g) UNION ALL SELECT raw_job_id, skill, 'MANUAL' FROM f WHERE (raw_job_id, skill) NOT IN (SELECT (raw_job_id, skill) FROM o)""",
    "emerged_in_holdout": f"""WITH t AS ({_YEAR('published_year = 2025')}), w AS ({_YEAR('published_year = 2026')}), h AS ({_YEAR(f'published_year = 2026 AND raw_job_id IN ({_HELD})')}),
      r AS (SELECT h.title, h.n, coalesce(t.n, 0) AS was, round(h.n * ((SELECT sum(n) FROM w) / greatest((SELECT sum(n) FROM h), 1)), 4) AS estimate FROM h LEFT JOIN t USING (title)) SELECT title, n, estimate FROM r WHERE was = 0 OR estimate >= greatest(2.0, was * 1.15)""",
    "question_terms": f"SELECT item_id, array_to_string(list_slice({_DISTINCT(f'list_concat(list_slice({_DISTINCT(_LATIN)}, 1, 3), {_HANS})')}, 1, 3), '|') AS terms FROM eval_item",
    "listed_values": f"SELECT id, array_to_string(list_slice({_DISTINCT('x')}, 1, 8), '|') AS items FROM (SELECT id, list_filter(list_transform(string_split_regex({_ITEMS}, '[、,，;；/\n]+'), lambda i: trim(i, ' ')), lambda i: i <> '' AND length(i) <= 60) AS x FROM dataset_job_raw WHERE industry IS NOT NULL)",
    "percentages": "SELECT id, printf('%.1f', round(CAST(confidence AS DOUBLE) * 1000) / 10) || '%' AS share, CASE WHEN a >= 0 THEN '+' ELSE '' END || printf('%.1f', a) || 'pp' AS above FROM (SELECT id, confidence, round(round((CAST(confidence AS DOUBLE) - 0.8::DOUBLE) * 100, 2), 1) AS a FROM zhitu_governed_job_skill WHERE confidence IS NOT NULL)",
    "plausible_skills": f"SELECT DISTINCT skill_name, {_PLAUSIBLE('skill_name')} AS plausible FROM zhitu_governed_job_skill WHERE skill_name IS NOT NULL",
    "published_relations": _PUB,
    "readiness": f"""SELECT total, processed, valid, greatest(0, processed - 1000) AS pending, processed >= 100 AND valid > 0 AS ready, processed >= total AS complete, CASE WHEN processed > 0 THEN processed ELSE total END AS shown, processed // 100 AS version FROM
      (SELECT (SELECT count(*) FROM dataset_job_raw) AS total, count(*) AS processed, count(*) FILTER ({OK}) AS valid FROM zhitu_governed_job)""",
    "daily_trend": "SELECT CAST(published_at AS VARCHAR) AS day, count(*) AS rows FROM zhitu_governed_job WHERE published_at IS NOT NULL GROUP BY published_at ORDER BY published_at DESC LIMIT 30",
}
SQL = all_blank_trim({k: v.replace("$$$$", "''") for k, v in SQL.items()})
