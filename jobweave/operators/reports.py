"""What readers look at: explained changes, matches and plans beside what they belong to, details of discovered roles, newest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions.evidence import percent, points
from jobweave.functions.measures import analysable, blank_null
from jobweave.functions.text import jaccard, tokens
from jobweave.functions.titles import clean_title, plausible_title
from jobweave.operators.evolution import changes, skill_rates
from jobweave.operators.forecast import discovered, title_years
from jobweave.operators.market import REGISTRY, QueryPlan, run_plan, titled
from jobweave.sources.scratch import cut

# How a change is called in its explanation, and the scenario of a stack that states none.
TRENDS = (("WEAKENED", "降温"), ("MODIFIED", "口径变化"))
DEFAULT_SCENARIOS = (("大模型", "企业知识库、智能客服与智能体业务自动化"), ("大数据", "实时数仓、数据治理与经营分析"), ("物联网", "工业物联网、边缘感知与智能设备协同"), ("智能系统", "工业智能、机器人与数字孪生系统"), ("后端", "企业级平台、微服务与高并发业务系统"))
OTHER_SCENARIO = "人工智能应用、智能决策与数字化业务场景"
EVIDENCE_ROWS = 12


def explained(changes: DataFrame) -> DataFrame:
    """(title_standard, skill_name, change, explanation): each change in words with its rates and forecast step."""
    trend = F.lit("升温")
    for change, word in TRENDS:
        trend = F.when(F.col("change") == change, word).otherwise(trend)
    text = F.concat(
        F.lit("证据覆盖由 "), percent(F.col("old_rate")), F.lit(" 变化到 "), percent(F.col("new_rate")), F.lit("，预测净影响 "), points(F.col("forecast_delta")), F.lit("。“"),
        F.col("title_standard"), F.lit(" · "), F.col("skill_name"), F.lit("”被判定为"), trend, F.lit("信号，证据 "), F.col("evidence").cast("string"), F.lit(" 条。"),
    )
    return changes.select("title_standard", "skill_name", "change", "confidence", text.alias("explanation"))


def stated_delta(explanation: Column, change: Column, confidence: Column) -> Column:
    """The size and direction of a change as its explanation states it: last percentage less the first, else from the confidence."""
    found = F.transform(F.regexp_extract_all(explanation, F.lit(r"(\d+(?:\.\d+)?)%"), F.lit(1)), lambda x: x.cast("double"))
    several = F.element_at(found, -1) - found[0]
    diff = F.when(F.size(found) >= 2, several).when(F.size(found) == 1, found[0]).otherwise(0.0)
    sure = F.coalesce(confidence, F.lit(0.5))
    size = lambda factor, least: F.greatest(F.lit(least), F.abs(F.when(diff != 0, diff).otherwise(sure * factor)))
    return F.round(F.when(change == "WEAKENED", -size(18, 1.0)).when(change == "ADDED", size(16, 1.0)).otherwise(size(6, 0.5)), 4)


def net_momentum(explained_changes: DataFrame) -> DataFrame:
    """(title_standard, changes, net): what the stated changes of each role add up to."""
    delta = stated_delta(F.col("explanation"), F.col("change"), F.col("confidence"))
    return explained_changes.groupBy("title_standard").agg(F.count(F.lit(1)).alias("changes"), F.round(F.sum(delta), 2).alias("net"))


def match_report(matches: DataFrame, roles: DataFrame, documents: DataFrame) -> DataFrame:
    """Matches with the listed role and the document they belong to."""
    listed = roles.select(F.col("id").alias("role_id"), F.trim("role_name").alias("role"), "tech_stack", "level_name")
    source = documents.select(F.col("doc_id").alias("id"), "source", "lang")
    return matches.join(F.broadcast(listed), "role").join(source, "id")  # the reference list


def plan_report(plans: DataFrame, report: DataFrame) -> DataFrame:
    """Stages of learning plans with the best match of the profile, its role and document."""
    return plans.join(report.where("place = 1").select("id", "role_id", "overall", "source"), "id")


def default_scenario(stack: Column) -> Column:
    out = F.lit(OTHER_SCENARIO)
    for word, scenario in reversed(DEFAULT_SCENARIOS):
        out = F.when(F.contains(stack, F.lit(word)), scenario).otherwise(out)
    return out


def discovered_details(found: DataFrame, skills: DataFrame, jobs: DataFrame, most: int = 8, scenarios: int = 3) -> DataFrame:
    """(year, shown, skills, stack, scenarios): discovered roles with their strongest skills of the year, stack and industries.

    ``found`` (year, shown, ...) is small, at most the top of each year, and prunes the
    postings before they meet their skills.
    """
    wanted = found.select("year", "shown")
    rows = jobs.where(analysable() & titled()).select("raw_job_id", F.col("published_year").alias("year"), F.col("title_standard").alias("shown"), "tech_stack", blank_null("industry").alias("industry"))
    rows = rows.join(F.broadcast(wanted), ["year", "shown"], "left_semi")  # at most the top of each year
    named = rows.join(skills.where("skill_name is not null").select("raw_job_id", "skill_name").distinct(), "raw_job_id").groupBy("year", "shown", "skill_name").agg(F.count(F.lit(1)).alias("n"))
    first = lambda df, value, k: (
        df.withColumn("p", F.row_number().over(Window.partitionBy("year", "shown").orderBy(F.desc("n"), F.asc(value)))).where(F.col("p") <= k)
        .groupBy("year", "shown").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", value))), lambda x: x[value]), "|").alias(value))
    )
    of_year = first(named, "skill_name", most).withColumnRenamed("skill_name", "skills")
    industries = rows.where("industry is not null").groupBy("year", "shown", "industry").agg(F.count(F.lit(1)).alias("n"))
    stack = rows.groupBy("year", "shown").agg(F.coalesce(F.max(blank_null("tech_stack")), F.lit("新一代信息技术")).alias("stack"))
    joined = wanted.join(of_year, ["year", "shown"], "left").join(stack, ["year", "shown"], "left").join(first(industries, "industry", scenarios), ["year", "shown"], "left")
    told = F.when(F.col("industry").isNotNull(), F.concat(F.col("industry"), F.lit(" · "), default_scenario(F.col("stack")))).otherwise(default_scenario(F.col("stack")))
    return joined.select("year", "shown", F.coalesce("skills", F.lit("")).alias("skills"), "stack", told.alias("scenarios"))


def presented(candidates: DataFrame, title: str) -> DataFrame:
    """Stored candidates as they are shown: titles cleaned again, those that name no single role left out."""
    return candidates.withColumn(title, clean_title(F.col(title))).where(plausible_title(F.col(title)))


def newest(df: DataFrame, id_col: str, k: int, *columns: str) -> DataFrame:
    """The ``k`` rows (1 to 500) of the largest ids, newest first."""
    return df.orderBy(F.desc(id_col)).limit(max(1, min(500, k))).select(id_col, *columns)


def evidence_of(plan: QueryPlan, jobs: DataFrame, skills: DataFrame, most: int = EVIDENCE_ROWS) -> DataFrame:
    """(place, kind, evidence): up to ``most`` rows of a plan's answer as text, behind a first row that says what was asked."""
    answer = run_plan(plan, jobs, skills)
    told = F.concat_ws("; ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in answer.columns])
    rows = answer.limit(most).select(F.monotonically_increasing_id().alias("o"), told.alias("evidence"))
    placed = rows.withColumn("place", F.row_number().over(Window.orderBy("o"))).select("place", F.lit(plan.kind).alias("kind"), "evidence")  # at most `most` rows
    meta = jobs.sparkSession.createDataFrame([(0, plan.kind, f"year={plan.year or ''}; limit={plan.limit}; role={plan.role or ''}")], "place int, kind string, evidence string")
    return meta.unionByName(placed)


def variant_skills(skills: DataFrame, jobs: DataFrame, variants: list[str]) -> DataFrame:
    """Skills of postings with any of several spellings of one title."""
    kept = jobs.where(analysable() & F.trim("title_standard").isin(*variants)).select("raw_job_id")
    return skills.where("skill_name is not null").join(kept, "raw_job_id", "left_semi").groupBy("skill_name").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("raw_job_id").alias("postings"))


def with_fallback(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of ``first``, and those of ``second`` whose key ``first`` does not have; ``origin`` tells them apart."""
    rest = second.join(first.select(key).distinct(), key, "left_anti")
    return first.withColumn("origin", F.lit("snapshot")).unionByName(rest.withColumn("origin", F.lit("published")))


def left_out(raw: DataFrame, parsed: DataFrame, raw_key: str, parsed_key: str, group: str) -> DataFrame:
    """(group, parsed, left): of each group how many raw rows are parsed and how many still wait."""
    done = parsed.select(F.col(parsed_key).alias("__k")).distinct()
    joined = raw.select(raw_key, group).join(done, F.col(raw_key) == F.col("__k"), "left")
    return joined.groupBy(group).agg(F.count("__k").alias("parsed"), F.count_if(F.col("__k").isNull()).alias("left"))


def coverage(relation: DataFrame, group: str, evidence: str) -> DataFrame:
    """(group, rows, told, share): how much of a relation has evidence."""
    told = F.count_if(F.trim(evidence) != "")
    return relation.groupBy(F.coalesce(F.col(group), F.lit("")).alias(group)).agg(F.count(F.lit(1)).alias("rows"), told.alias("told"), F.round(told / F.count(F.lit(1)), 6).alias("share"))


def positions(df: DataFrame, id_col: str, parts: int) -> DataFrame:
    """``df`` with ``position``, the place of each row in the order of ``id_col``, without one task seeing all rows.

    Rows are dealt by ranges of the id; a row's place is that within its range behind the
    sizes of the ranges before it, of which there are ``parts``.
    """
    ranged = cut(df.repartitionByRange(parts, id_col).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")  # `parts` rows
    within = F.row_number().over(Window.partitionBy("__part").orderBy(id_col))
    return ranged.withColumn("__k", within).join(F.broadcast(before), "__part").withColumn("position", F.col("__before") + F.col("__k")).drop("__part", "__k", "__before")


def recent_copies(df: DataFrame, id_col: str, text_col: str, back: int = 200, threshold: float = 0.82, parts: int = 64) -> DataFrame:
    """(id, copy_of, similarity): of each text the nearest of the ``back`` texts before it whose words are alike to ``threshold``.

    As a bounded look-back over a stream sees it, for all rows at once: texts meet only within
    neighbouring stretches of ``back`` positions and over their rarer words, of which two
    texts as alike as that share one.
    """
    words = positions(df.select(F.col(id_col).alias("id"), F.array_sort(tokens(F.col(text_col))).alias("t")).where(F.size("t") > 0), "id", parts)
    words = cut(words)
    each = words.select("id", "position", F.size("t").alias("n"), F.explode("t").alias("token"))
    rarity = each.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ordered = each.join(rarity, "token").withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("df", "token")))
    prefix = ordered.where(F.col("k") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).select("position", "token")
    stretch = F.floor((F.col("position") - 1) / back)
    late = prefix.select(F.col("position").alias("b"), "token", F.explode(F.array(stretch, stretch - 1)).alias("s"))
    early = prefix.select(F.col("position").alias("a"), "token", stretch.alias("s"))
    met = late.join(early, ["token", "s"]).where((F.col("b") > F.col("a")) & (F.col("b") - F.col("a") <= back)).select("a", "b").distinct()
    side = lambda p, t, i: words.select(F.col("position").alias(p), F.col("t").alias(t), F.col("id").alias(i))
    scored = met.join(side("a", "ta", "ia"), "a").join(side("b", "tb", "ib"), "b").select("ib", "ia", "a", F.round(jaccard(F.col("ta"), F.col("tb")), 6).alias("similarity")).where(F.col("similarity") >= threshold)
    best = scored.groupBy("ib").agg(F.max(F.struct("a", "ia", "similarity")).alias("m"))
    return best.select(F.col("ib").alias("id"), F.col("m.ia").alias("copy_of"), "m.similarity")


REGISTRY["EMERGING_CANDIDATES"] = lambda p, jobs, skills: discovered(title_years(jobs)).where(F.lit(p.year is None) | (F.col("year") == (p.year or 0))).orderBy("year", "place").limit(p.limit)
REGISTRY["EVOLUTION_EVENTS"] = lambda p, jobs, skills: changes(skill_rates(skills, jobs, ((p.year or 2026) - 1, p.year or 2026)), ((p.year or 2026) - 1, p.year or 2026)).orderBy(F.desc("confidence"), "title_standard", "skill_name").limit(p.limit)
