"""Graph, evolution, forecast and discovery queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.functions import text as T
from jobweave.operators import evolution as V
from jobweave.operators import forecast as P
from jobweave.operators import graph as G
from jobweave.plans.market_queries import EV, JOINED, OK, TITLED
from jobweave.plans.sql import all_blank_trim
from jobweave.sources.scratch import cut
from jobweave.sources.tables import table

YEARS = (2024, 2025)


def _j(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "governed")


def _k(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "governed_skill")


def _edges(s: SparkSession, d: str) -> DataFrame:
    return G.edges(_k(s, d), _j(s, d))


def _years(s: SparkSession, d: str) -> DataFrame:
    return P.title_years(_j(s, d))


def graph_expanded(s: SparkSession, d: str) -> DataFrame:
    """Nodes within two hops of the most frequent role."""
    jobs = _j(s, d)
    seed = G.role_nodes(jobs).orderBy(F.desc("sample_count"), *G.ROLE_KEY).limit(1).select(F.concat(F.lit("R:"), "role_name").alias("node"))
    return G.expand(G.edges(_k(s, d), jobs), seed)


def forecast_candidates(s: SparkSession, d: str) -> DataFrame:
    r = [F.round(c, 5).alias(c) for c in ("novelty", "momentum", "score", "confidence")]
    return P.candidates(_years(s, d)).select("year", "place", "title", "n", "previous", *r)


def backtest_rows(s: SparkSession, d: str) -> DataFrame:
    rows = P.backtest_rows(_years(s, d))
    return rows.select("year", "place", "title", F.round("similarity", 5).alias("similarity"), "actual", "actual_count", "hit")


def backtest_windows(s: SparkSession, d: str) -> DataFrame:
    years = cut(_years(s, d))  # read by candidates, matches and truth
    return P.backtest(P.backtest_rows(years), P.emerged(years))


def title_similarities(s: SparkSession, d: str) -> DataFrame:
    """Similarity of each role of the reference list to the roles of the same stack with a larger id."""
    roles = table(s, d, "job_role").select("id", "tech_stack", F.col("normalized_name").alias("name"))
    other = roles.select(F.col("id").alias("id_b"), "tech_stack", F.col("name").alias("name_b"))
    pairs = roles.join(other, "tech_stack").where("id < id_b")
    return pairs.select(F.col("id").alias("id_a"), "id_b", F.round(T.title_similarity(F.col("name"), F.col("name_b")), 6).alias("similarity"))


QUERIES = {
    "graph_roles": lambda s, d: G.role_nodes(_j(s, d)),
    "graph_edges": _edges,
    "graph_skills": lambda s, d: G.skill_nodes(_edges(s, d)),
    "graph_summary": lambda s, d: G.summary(G.role_nodes(_j(s, d)), _edges(s, d)),
    "graph_stacks": lambda s, d: G.stack_distribution(G.role_nodes(_j(s, d))),
    "graph_panorama": lambda s, d: G.panorama(_k(s, d), _j(s, d)),
    "graph_of_level": lambda s, d: G.panorama(_k(s, d), _j(s, d), 48, 400, 2, level="高级"),
    "graph_quality": lambda s, d: G.quality(G.role_nodes(_j(s, d))),
    "graph_neighbours": lambda s, d: G.top_neighbours(_edges(s, d)),
    "graph_expanded": graph_expanded,
    "graph_retrieval": lambda s, d: G.retrieve(_edges(s, d), "边缘平台工程师需要哪些技能，Edge Integration Engineer 呢"),
    "evolution_rates": lambda s, d: V.skill_rates(_k(s, d), _j(s, d), YEARS).select("published_year", "title_standard", "skill_name", "evidence", F.round("support", 4).alias("support"), F.round("rate", 5).alias("rate")),
    "evolution_changes": lambda s, d: V.changes(V.skill_rates(_k(s, d), _j(s, d), YEARS), YEARS),
    "title_years": lambda s, d: _years(s, d).withColumn("quality", F.round("quality", 5)),
    "forecast_candidates": forecast_candidates,
    "forecast_emerged": lambda s, d: P.emerged(_years(s, d)),
    "backtest_rows": backtest_rows,
    "backtest_windows": backtest_windows,
    "discovered_roles": lambda s, d: P.discovered(_years(s, d)),
    "discovery_years": lambda s, d: P.target_years(_years(s, d)),
    "title_similarities": title_similarities,
}

_LABELS = "trim(title_standard) AS role_name, coalesce(nullif(trim(tech_stack), ''), '未分类') AS tech_stack, coalesce(nullif(trim(level_name), ''), '未标注') AS level_name"
_SAT = lambda x, full: f"least(greatest(ln(1 + CAST({x} AS DOUBLE)) / ln({float(full)}), 0), 1)"
_ROLES = f"""SELECT *, round({_SAT('sample_count', 500)}, 6) AS importance FROM (SELECT {_LABELS}, count(*) AS sample_count, round(sum(CAST(duplicate_weight AS DOUBLE)), 4) AS weight,
  round(avg(CAST(quality_score AS DOUBLE)), 6) AS confidence FROM zhitu_governed_job WHERE {OK} AND {TITLED} GROUP BY ALL)"""
_EDGES = f"""SELECT *, CASE WHEN required_weight <= 0 AND bonus_weight <= 0 THEN 'MENTIONED' WHEN required_weight >= bonus_weight THEN 'REQUIRED' ELSE 'BONUS' END AS relation, round({_SAT('support_weight', 100)}, 6) AS weight FROM (
  SELECT {_LABELS}, skill_name, count(*) AS evidence_count, count(DISTINCT {EV}) AS evidence_distinct, round(sum(support), 4) AS support_weight, round(sum(CASE WHEN kind = 'REQUIRED' THEN support ELSE 0 END), 4) AS required_weight,
  round(sum(CASE WHEN kind IN ('BONUS', 'PREFERRED') THEN support ELSE 0 END), 4) AS bonus_weight, round(avg(c), 6) AS confidence, max(skill_stack) AS skill_stack, max(category) AS category
  FROM (SELECT j.*, CAST(s2.confidence AS DOUBLE) AS c FROM {JOINED} j JOIN zhitu_governed_job_skill s2 ON j.id = s2.id) WHERE {TITLED} GROUP BY trim(title_standard), 2, 3, skill_name)"""
_KEYS = "role_name, tech_stack, level_name"
_FT = f"regexp_replace(lower(coalesce(title_standard, '')), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"  # noqa: F541
for _p in (T.SHORT_BRACKETS, T.FORECAST_LEVELS, T.FORECAST_NOISE):
    _FT = f"regexp_replace({_FT}, '{_p}', ' ', 'g')"
for _a, _b in T.FORECAST_SYNONYMS:
    _FT = f"replace({_FT}, '{_a}', '{_b}')"
_SPC = lambda x: f"trim(regexp_replace({x}, ' +', ' ', 'g'), ' ')"
_FT = _SPC(f"regexp_replace({_FT}, '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}+#.]+', ' ', 'g')")
_FT = _SPC(f"regexp_replace({_FT}, '{T.JOB_SUFFIX}', '', 'g')")
_TY = f"""SELECT year, title, sum(n)::BIGINT AS n, sum(h1)::BIGINT AS h1, sum(h2)::BIGINT AS h2, sum(companies)::BIGINT AS companies, sum(sources)::BIGINT AS sources, sum(q * n) / sum(n) AS quality,
  arg_max(title_standard, (n, title_standard)) AS shown FROM (SELECT published_year AS year, {_FT} AS title, * FROM (SELECT published_year, title_standard, count(DISTINCT {EV}) AS n,
  count(DISTINCT CASE WHEN month(published_at) <= 6 THEN {EV} END) AS h1, count(DISTINCT CASE WHEN month(published_at) > 6 THEN {EV} END) AS h2, count(DISTINCT nullif(trim(company), '')) AS companies,
  count(DISTINCT nullif(trim(source_name), '')) AS sources, avg(CAST(quality_score AS DOUBLE)) AS q FROM zhitu_governed_job WHERE {OK} AND {TITLED} AND published_year BETWEEN 2000 AND 2100 GROUP BY 1, 2)) WHERE length(title) >= 2 GROUP BY 1, 2"""
_C01 = lambda x: f"least(greatest({x}, 0), 1)"
_CAND = f"""y AS ({_TY}), a AS (SELECT c.*, coalesce(p.n, 0) AS previous FROM y c LEFT JOIN y p ON p.title = c.title AND p.year = c.year - 1 WHERE c.n >= 3),
b AS (SELECT *, CASE WHEN previous = 0 THEN 1.0::DOUBLE ELSE {_C01('1 - least(1.0::DOUBLE, previous / greatest(1, n))')} END AS novelty, CASE WHEN h1 + h2 = 0 THEN 0.0::DOUBLE ELSE {_C01('0.5::DOUBLE + 0.5::DOUBLE * (h2 - h1) / (h1 + h2)')} END AS momentum,
  {_SAT('n', 60)} AS support, {_C01('companies / greatest(3, least(n, 15))')} AS diversity, CASE WHEN h1 + h2 = 0 THEN 0.0::DOUBLE ELSE {_C01('1 - abs(h1 - h2) / (h1 + h2)')} END AS balance FROM a),
s AS (SELECT *, {_C01('0.34::DOUBLE * novelty + 0.28::DOUBLE * momentum + 0.20::DOUBLE * support + 0.18::DOUBLE * diversity')} AS score,
  {_C01('0.38::DOUBLE * support + 0.34::DOUBLE * diversity + 0.18::DOUBLE * balance + 0.10::DOUBLE * CASE WHEN n >= 5 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END')} AS confidence FROM b),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY round(score, 9) DESC, n DESC, title) AS place FROM s WHERE score >= 0.52 AND (novelty >= 0.40 OR (novelty >= 0.15 AND momentum >= 0.60))) WHERE place <= 50)"""
_EMERGED = """emerged AS (SELECT c.year - 1 AS year, c.title FROM y c LEFT JOIN y p ON p.title = c.title AND p.year = c.year - 1 WHERE c.year - 1 IN (SELECT year FROM y) AND c.n >= 3 AND (coalesce(p.n, 0) = 0 OR c.n >= greatest(3.0, p.n * 1.25)))"""
_G = lambda x: f"(CASE WHEN length({x}) <= 1 THEN list_filter([{x}], lambda v: v <> '') ELSE list_distinct(list_transform(range(1, length({x})), lambda k: substring({x}, k, 2))) END)"


def _similar(a: str, b: str) -> str:
    ca, cb = f"replace({a}, ' ', '')", f"replace({b}, ' ', '')"
    both = f"len(list_intersect({_G(ca)}, {_G(cb)}))"
    return f"""CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {ca} = {cb} THEN 0.98::DOUBLE WHEN contains({ca}, {cb}) OR contains({cb}, {ca}) THEN least(1.0::DOUBLE, 0.76::DOUBLE + 0.20::DOUBLE * (least(length({ca}), length({cb})) / greatest(length({ca}), length({cb}))))
      ELSE {both} / (len({_G(ca)}) + len({_G(cb)}) - {both}) END"""


_MATCH = f"""pairs AS (SELECT c.year, c.title AS predicted, a.title AS actual, a.n AS actual_count, round({_similar('c.title', 'a.title')}, 9) AS similarity FROM cand c JOIN y a ON a.year = c.year + 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year, predicted ORDER BY similarity DESC, actual_count DESC, actual DESC) AS k FROM pairs WHERE similarity > 0) WHERE k = 1),
bt AS (SELECT c.*, b.actual, b.actual_count, coalesce(b.similarity, 0) AS similarity, coalesce(b.similarity >= 0.72 AND b.actual_count >= greatest(3.0, c.n * 1.25), false) AS hit FROM cand c LEFT JOIN best b ON b.year = c.year AND b.predicted = c.title WHERE c.year + 1 IN (SELECT year FROM y))"""
_RATES = f"""top AS (SELECT title_standard FROM (SELECT title_standard, count(DISTINCT {EV}) AS n FROM zhitu_governed_job WHERE {OK} AND {TITLED} AND published_year = 2025 GROUP BY 1) ORDER BY n DESC, title_standard LIMIT 100),
cnt AS (SELECT published_year, title_standard, count(DISTINCT {EV}) AS role_count FROM zhitu_governed_job WHERE {OK} AND {TITLED} AND published_year IN (2024, 2025) AND title_standard IN (FROM top) GROUP BY 1, 2),
rates AS (SELECT s.*, s.support / c.role_count AS rate FROM (SELECT published_year, title_standard, skill_name, count(DISTINCT {EV}) AS evidence, sum(support) AS support, sum(CASE WHEN kind = 'REQUIRED' THEN support ELSE 0 END) AS required,
  sum(CASE WHEN kind IN ('BONUS', 'PREFERRED') THEN support ELSE 0 END) AS bonus FROM {JOINED} WHERE {TITLED} AND published_year IN (2024, 2025) GROUP BY 1, 2, 3) s JOIN cnt c USING (published_year, title_standard))"""
_DISC = f"""y AS ({_TY}), a AS (SELECT *, CASE WHEN h1 + h2 = 0 THEN 0.5::DOUBLE ELSE h2 / greatest(1, h1 + h2) END AS late, CASE WHEN h1 = 0 THEN CASE WHEN h2 > 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END ELSE {_C01('0.5::DOUBLE + 0.5::DOUBLE * (h2 - h1) / greatest(1, h1 + h2)')} END AS growth,
  h1 = 0 AND h2 > 0 AS fresh, {_SAT('n', 201)} AS support, {_C01('0.45::DOUBLE + least(0.30::DOUBLE, companies / 80) + least(0.25::DOUBLE, sources / 12)')} AS diversity FROM y WHERE n >= 6 AND companies >= 2 AND sources >= 2),
b AS (SELECT *, 0.3::DOUBLE * CASE WHEN fresh THEN 1.0::DOUBLE ELSE {_C01('0.30::DOUBLE + 0.70::DOUBLE * late')} END + 0.25::DOUBLE * support + 0.25::DOUBLE * growth + 0.1::DOUBLE * least(1.0::DOUBLE, sources / 4) + 0.1::DOUBLE * least(1.0::DOUBLE, n / 12) AS novelty,
  {_C01('0.25::DOUBLE * least(1.0::DOUBLE, n / 8) + 0.25::DOUBLE * least(1.0::DOUBLE, sources / 4) + 0.20::DOUBLE * least(greatest(quality, 0), 1) + 0.20::DOUBLE * diversity + 0.10::DOUBLE * (1 - 0.08::DOUBLE)')} AS confidence FROM a),
d AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY round(novelty, 9) DESC, round(growth, 9) DESC, n DESC, title) AS place FROM b WHERE novelty >= 0.52 AND confidence >= 0.55 AND (fresh OR (growth >= 0.54 AND late >= 0.58)))"""
_HASH = "list_reduce(list_transform(list_filter(string_split(lower(skill_name), ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, u: (h * 31 + u) % 4294967296, CAST(0 AS BIGINT))"
_MARKET = "CASE " + " ".join(f"WHEN regexp_matches(lower(skill_name), '{p}') THEN {w}::DOUBLE" for w, p in V.MARKET) + f" ELSE 0.88::DOUBLE + 0.035::DOUBLE * abs((CASE WHEN {_HASH} >= 2147483648 THEN {_HASH} - 4294967296 ELSE {_HASH} END) % 9) END"
_WIDE = ", ".join(f"max(CASE WHEN published_year = {y} THEN {c} END) AS {c}_{t}" for t, y in (("old", 2024), ("new", 2025)) for c in ("evidence", "support", "required", "bonus", "rate"))
_KIND = lambda t: f"CASE WHEN required_{t} >= bonus_{t} THEN 'R' ELSE 'B' END"
_HAS, _HAD = "evidence_new IS NOT NULL", "evidence_old IS NOT NULL"
_CHANGES = f"""WITH {_RATES}, w AS (SELECT title_standard, skill_name, {_WIDE} FROM rates GROUP BY 1, 2), a AS (SELECT *, coalesce(rate_old, 0) AS r_old, coalesce(rate_new, 0) AS r_new FROM w),
b AS (SELECT *, CASE WHEN NOT ({_HAD}) AND evidence_new >= 3 AND r_new >= 0.08 THEN 'ADDED' WHEN {_HAD} AND {_HAS} AND {_KIND('old')} <> {_KIND('new')} AND evidence_old >= 3 AND evidence_new >= 3 THEN 'MODIFIED'
  WHEN {_HAD} AND r_old >= 0.08 AND (NOT ({_HAS}) OR r_new <= r_old * 0.45) THEN 'WEAKENED' WHEN {_HAD} AND {_HAS} AND r_new >= greatest(0.12::DOUBLE, r_old * 1.8) AND evidence_new >= 5 THEN 'ADDED' END AS change FROM a),
c AS (SELECT *, CASE WHEN {_HAS} THEN evidence_new ELSE evidence_old END AS e, CASE WHEN {_HAS} THEN support_new ELSE support_old END AS s, CASE WHEN {_HAS} THEN required_new ELSE required_old END AS q, {_MARKET} AS market, (r_new - r_old) * 100 AS delta,
  greatest(coalesce(evidence_new, 0), coalesce(evidence_old, 0)) AS most FROM b WHERE change IS NOT NULL),
d AS (SELECT *, least(8.0::DOUBLE, ln(1 + e) * 2.3::DOUBLE) AS be, least(6.0::DOUBLE, ln(1 + s) * 1.3::DOUBLE) AS bs, CASE WHEN s > 0 THEN {_C01('q / s')} ELSE 0 END * 5 AS br,
  round(least(greatest(CASE WHEN e >= 8 THEN 0.035::DOUBLE WHEN e >= 5 THEN 0.055::DOUBLE ELSE 0.08::DOUBLE END + CASE WHEN abs(r_new - r_old) >= 0.12 THEN -0.012::DOUBLE ELSE 0.008::DOUBLE END, 0.03), 0.095), 3) AS risk FROM c)
SELECT title_standard, skill_name, change, round(r_old, 4) AS old_rate, round(r_new, 4) AS new_rate, most AS evidence, round(CASE change
  WHEN 'WEAKENED' THEN -least(greatest(greatest(4.0::DOUBLE, abs(delta) * (0.95::DOUBLE + 1 / greatest(1.0::DOUBLE, market)) + be * 0.45::DOUBLE), 3), 45)
  WHEN 'MODIFIED' THEN CASE WHEN required_new >= required_old THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * least(greatest(greatest(2.0::DOUBLE, abs(delta) * 0.55::DOUBLE + br + be * 0.25::DOUBLE), 2), 24)
  ELSE least(greatest(greatest(delta, 2) * market + be + bs * 0.45::DOUBLE + br * 0.35::DOUBLE, 4), 45) END, 1) AS forecast_delta, risk, round({_C01('greatest(0.55::DOUBLE, 1 - risk) + least(0.05::DOUBLE, ln(1 + most) / 80)')}, 4) AS confidence FROM d"""
_Q = "边缘平台工程师需要哪些技能，edge integration engineer 呢"
SQL = {
    "graph_roles": _ROLES,
    "graph_edges": _EDGES,
    "graph_skills": f"""SELECT *, round({_SAT('support_weight', 120)}, 5) AS importance FROM (SELECT skill_name, round(sum(support_weight), 4) AS support_weight, round(sum(required_weight), 4) AS required_weight, round(sum(bonus_weight), 4) AS bonus_weight,
      sum(evidence_count)::BIGINT AS evidence_count, count(*) AS role_count, round(avg(confidence), 5) AS confidence, max(category) AS category FROM ({_EDGES}) GROUP BY 1)""",
    "graph_summary": f"""WITH e AS ({_EDGES}), r AS ({_ROLES}) SELECT (SELECT count(*) FROM r SEMI JOIN e USING ({_KEYS})) AS roles, count(DISTINCT skill_name) AS skills, count(*) AS edges, count(*) FILTER (relation = 'REQUIRED') AS required,
      count(*) FILTER (relation = 'BONUS') AS bonus, count(*) FILTER (relation = 'MENTIONED') AS mentioned, round(avg(confidence), 5) AS mean_confidence FROM e""",
    "graph_stacks": f"SELECT tech_stack, count(*) AS roles, sum(sample_count)::BIGINT AS samples FROM ({_ROLES}) GROUP BY 1",
    "graph_panorama": f"WITH e AS ({_EDGES}), t AS (SELECT {_KEYS} FROM ({_ROLES}) ORDER BY sample_count DESC, {_KEYS} LIMIT 24) SELECT e.* FROM e SEMI JOIN t USING ({_KEYS}) ORDER BY support_weight DESC, {_KEYS}, skill_name LIMIT 200",
    "graph_of_level": f"WITH e AS ({_EDGES}), t AS (SELECT {_KEYS} FROM ({_ROLES}) WHERE level_name = '高级' ORDER BY sample_count DESC, {_KEYS} LIMIT 48) SELECT e.* FROM e SEMI JOIN t USING ({_KEYS}) WHERE evidence_count >= 2 ORDER BY support_weight DESC, {_KEYS}, skill_name LIMIT 400",
    "graph_quality": f"SELECT count(*) AS nodes, round(avg(confidence) * 100, 2) AS quality FROM ({_ROLES})",
    "graph_neighbours": f"SELECT {_KEYS}, skill_name, evidence_count, place FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY evidence_count DESC, skill_name) AS place FROM ({_EDGES})) WHERE place <= 16",
    "graph_expanded": f"""WITH e AS (SELECT DISTINCT 'R:' || role_name AS a, 'S:' || skill_name AS b FROM ({_EDGES})), g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), s AS (SELECT 'R:' || role_name AS node FROM ({_ROLES}) ORDER BY sample_count DESC, {_KEYS} LIMIT 1),
      h1 AS (SELECT DISTINCT b AS node FROM g WHERE a IN (FROM s) AND b NOT IN (FROM s)), h2 AS (SELECT DISTINCT b AS node FROM g WHERE a IN (FROM h1) AND b NOT IN (FROM s) AND b NOT IN (FROM h1))
      SELECT node, 0 AS hops FROM s UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""",
    "graph_retrieval": f"""SELECT {_KEYS}, skill_name, relation, support_weight, place FROM (SELECT *, row_number() OVER (PARTITION BY role_name ORDER BY support_weight DESC, skill_name, tech_stack, level_name) AS place FROM ({_EDGES})
      WHERE (length(role_name) >= 2 AND contains('{_Q}', lower(role_name))) OR (length(skill_name) >= 2 AND contains('{_Q}', lower(skill_name)))) WHERE place <= 8""",
    "evolution_rates": f"WITH {_RATES} SELECT published_year, title_standard, skill_name, evidence, round(support, 4) AS support, round(rate, 5) AS rate FROM rates",
    "evolution_changes": _CHANGES,
    "title_years": f"SELECT * REPLACE (round(quality, 5) AS quality) FROM ({_TY})",
    "forecast_candidates": f"WITH {_CAND} SELECT year, place, title, n, previous, round(novelty, 5) AS novelty, round(momentum, 5) AS momentum, round(score, 5) AS score, round(confidence, 5) AS confidence FROM cand",
    "forecast_emerged": f"WITH y AS ({_TY}), {_EMERGED} SELECT * FROM emerged",
    "backtest_rows": f"WITH {_CAND}, {_MATCH} SELECT year, place, title, round(similarity, 5) AS similarity, actual, actual_count, hit FROM bt",
    "backtest_windows": f"""WITH {_CAND}, {_MATCH}, {_EMERGED}, p AS (SELECT year, count(*) AS predicted, count(*) FILTER (hit) AS hits, sum(CASE WHEN hit THEN similarity ELSE 0 END) AS sim, sum(pow(score - hit::INT, 2)) AS brier, avg(confidence) AS sure FROM bt GROUP BY 1),
      f AS (SELECT year, count(*) AS found FROM (SELECT DISTINCT year, actual AS title FROM bt WHERE hit) SEMI JOIN emerged USING (year, title) GROUP BY 1), r AS (SELECT year, count(*) AS emerged FROM emerged GROUP BY 1),
      m AS (SELECT p.*, coalesce(r.emerged, 0) AS emerged, hits / predicted AS precision, coalesce(coalesce(f.found, 0) / r.emerged, 0) AS recall, {_C01('1 - brier / predicted')} AS calibration, CASE WHEN hits > 0 THEN sim / hits ELSE 0 END AS similarity FROM p LEFT JOIN r USING (year) LEFT JOIN f USING (year))
      SELECT year, predicted, hits, emerged, round(precision, 4) AS precision, round(recall, 4) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 4) AS f1, round(similarity, 4) AS similarity,
      round(calibration, 4) AS calibration, round({_C01('0.42::DOUBLE * precision + 0.20::DOUBLE * calibration + 0.18::DOUBLE * similarity + 0.20::DOUBLE * sure')}, 4) AS trust FROM m""",
    "discovered_roles": f"WITH {_DISC} SELECT year, place, title, shown, n, round(novelty, 5) AS novelty, round(growth, 5) AS growth, round(late, 5) AS late, round(confidence, 5) AS confidence FROM d WHERE place <= 30",
    "discovery_years": f"WITH y AS ({_TY}) SELECT DISTINCT year FROM y WHERE year - 1 IN (SELECT year FROM y)",
    "title_similarities": f"SELECT a.id AS id_a, b.id AS id_b, round({_similar('a.normalized_name', 'b.normalized_name')}, 6) AS similarity FROM job_role a JOIN job_role b ON a.tech_stack = b.tech_stack AND a.id < b.id",
}
SQL = all_blank_trim(SQL)
