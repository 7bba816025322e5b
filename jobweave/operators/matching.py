"""Profiles matched to roles, and learning plans for what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions.measures import analysable, clamp
from jobweave.operators.market import BONUS_TYPES, titled, with_jobs
from jobweave.sources.scratch import cut

WEIGHTS = {"skill": 0.40, "internship": 0.18, "project": 0.15, "stack": 0.12, "level": 0.09, "education": 0.06}
# Stages without a stated lack, the last stage, and the tiers of a plan from the first to the last.
GENERAL_STAGES = ("岗位基础规范", "核心工具链", "岗位专项能力", "业务场景交付", "复盘表达")
PROJECT_STAGE = "岗位综合项目"
TIERS = ("第一层：岗位基础", "第二层：核心技能", "进阶层：专项突破", "冲刺层：场景协作", "顶层：岗位作品")


def requirements(skills: DataFrame, jobs: DataFrame, top: int = 60) -> DataFrame:
    """(role, skill_name, kind, importance): the ``top`` skills of each role, support over the role's largest."""
    joined = with_jobs(skills, jobs, analysable() & titled(), "title_standard")
    part = lambda cond: F.sum(F.when(cond, F.col("support")).otherwise(F.lit(0.0)))
    per = joined.groupBy(F.trim("title_standard").alias("role"), "skill_name").agg(F.round(F.sum("support"), 6).alias("s"), part(F.col("kind") == "REQUIRED").alias("r"), part(F.col("kind").isin(*BONUS_TYPES)).alias("b"))
    ranked = per.withColumn("place", F.row_number().over(Window.partitionBy("role").orderBy(F.desc("s"), F.asc("skill_name")))).where(F.col("place") <= top)
    share = F.col("s") / F.greatest(F.max("s").over(Window.partitionBy("role")), F.lit(1e-9))
    untyped = (F.col("r") <= 0) & (F.col("b") <= 0)
    kind = F.when(F.col("b") > F.col("r"), "BONUS").otherwise("REQUIRED")
    return ranked.select("role", "skill_name", kind.alias("kind"), F.round(clamp(share, 0.08, 1.0) * F.when(untyped, 0.72).otherwise(1.0), 6).alias("importance"))


def skill_rows(profiles: DataFrame, *carried: Column) -> DataFrame:
    """(id, ``carried``, skill, in_projects, internships): what each profile's texts say about each of its skills.

    ``profiles`` has id, skills, projects (one text) and internships (an array of texts);
    ``internships`` of a row are the places of the texts that name the skill, case ignored.
    """
    low = profiles.select("id", *carried, "skills", F.lower(F.coalesce("projects", F.lit(""))).alias("p"), F.transform(F.coalesce("internships", F.array().cast("array<string>")), F.lower).alias("i"))
    each = low.withColumn("skill", F.explode(F.array_distinct("skills"))).where(F.trim("skill") != "")
    word = F.lower("skill")
    places = F.when(F.size("i") > 0, F.filter(F.transform("i", lambda t, k: F.when(F.contains(t, word), k)), lambda k: k.isNotNull()))
    return each.withColumns({"in_projects": F.contains("p", word), "internships": places}).drop("p", "i", "skills")


def profile_parts(profiles: DataFrame) -> DataFrame:
    """(id, years, internships, project, stack, education, own): the parts of the score that no role changes, in one pass over the profiles.

    ``own`` holds at most the dictionary.
    """
    education = F.when(F.col("education").isNull(), 60.0).when(F.col("education").rlike("硕士|博士"), 95.0).when(F.contains("education", F.lit("本科")), 88.0).otherwise(72.0)
    rows = skill_rows(profiles, F.coalesce("years", F.lit(0.0)).alias("years"), F.greatest(F.size("internships"), F.lit(0)).alias("interned"), education.alias("education"))
    own = rows.groupBy("id").agg(
        F.size(F.collect_set(F.when(F.col("in_projects"), F.col("skill")))).alias("named"), F.size(F.collect_set(F.split("skill", " ")[0])).alias("stacks"), F.collect_set(F.struct("skill", "internships")).alias("own"),
        F.max("years").alias("years"), F.max("interned").alias("internships"), F.max("education").alias("education"),
    )
    full = lambda v: F.least(F.lit(100.0), v)
    return own.select("id", "years", "internships", full(35.0 + F.col("named") * 10).alias("project"), full(45.0 + F.col("stacks") * 3).alias("stack"), "education", "own")


def role_totals(needs: DataFrame, levels: DataFrame) -> DataFrame:
    """(role, total, required, expected): weight of the required skills, their names and the years the role's level expects."""
    wanted = F.col("kind") == "REQUIRED"
    per = needs.groupBy("role").agg(F.sum(F.when(wanted, _micro()).otherwise(F.lit(0))).alias("total"), F.sort_array(F.collect_set(F.when(wanted, F.col("skill_name")))).alias("required"))
    level = F.coalesce("level", F.lit(""))
    expected = F.when(F.contains(level, F.lit("高")), 5.0).when(F.contains(level, F.lit("中")), 3.0).otherwise(1.0)
    return per.join(levels.select("role", expected.alias("expected")).groupBy("role").agg(F.max("expected").alias("expected")), "role", "left").withColumn("expected", F.coalesce("expected", F.lit(1.0)))


def _micro() -> Column:
    """Importance in millionths, so that sums do not depend on the order of rows."""
    return F.round(F.col("importance") * 1_000_000).cast("long")


def match_profiles(profiles: DataFrame, needs: DataFrame, levels: DataFrame, k: int = 5, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The ``k`` best roles of each profile that shares a skill with them: part scores, and the required skills it lacks.

    ``profiles`` has id, skills, projects, internships (texts), years and education; ``needs``
    those of :func:`requirements`, ``levels`` (role, level). Pairs come from shared skills, so
    no profile meets every role. What depends on the profile alone is computed once, texts
    stay behind, and one aggregation of the shared-skill join gives what is found of each
    role. Profiles are shuffled once, by id: with the requirements broadcast (up to
    ``broadcast_rows`` rows, joined by skill beyond) aggregation and ranking keep that
    partitioning. Profiles without skills and roles without requirements give no row; repeated
    ids count once.
    """
    # Both are read several times below, and are small beside the texts and postings they come from.
    parts, needs = cut(profile_parts(profiles)), cut(needs)
    small = needs.limit(broadcast_rows + 1).count() <= broadcast_rows
    near = F.broadcast if small else lambda df: df
    totals = role_totals(needs, levels)
    wanted = needs.select("role", F.col("skill_name").alias("skill"), (F.col("kind") == "REQUIRED").alias("required"), _micro().alias("weight"))
    fixed = ["years", "internships", "project", "stack", "education"]
    each = parts.repartition("id").select("id", *fixed, F.explode("own").alias("o")).select("id", *fixed, "o.skill", F.col("o.internships").alias("named_in"))
    pairs = each.join(near(wanted), "skill").groupBy("id", "role", *fixed).agg(
        F.sum(F.when(F.col("required"), F.col("weight")).otherwise(F.lit(0))).alias("hit"),
        F.count_if(~F.col("required")).alias("bonus"),
    )
    # Internships that name a required skill: few rows, so they are counted apart and joined.
    told = each.where(F.size("named_in") > 0).select("id", "skill", F.explode("named_in").alias("k"))
    relevant = told.join(near(wanted.where("required")), "skill").groupBy("id", "role").agg(F.countDistinct("k").alias("relevant"))
    pairs = pairs.join(relevant, ["id", "role"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    c = F.col
    full = lambda v: F.least(F.lit(100.0), v)
    scored = pairs.join(near(totals.select("role", "total", "expected")), "role").select(
        "id", "role", "project", "stack", "education",
        full(F.when(c("total") == 0, 0.0).otherwise(100.0 * c("hit") / c("total")) + F.least(F.lit(8), c("bonus") * 2)).alias("skill"),
        full(30.0 + c("internships") * 15 + c("relevant") * 5).alias("internship"),
        full(60 + F.least("years", "expected") / c("expected") * 40).alias("level"),
    )
    overall = sum((w * c(n) for n, w in list(WEIGHTS.items())[1:]), WEIGHTS["skill"] * c("skill"))
    scored = scored.withColumn("overall", F.round(overall + 1e-9, 1))
    order = Window.partitionBy("id").orderBy(F.desc("overall"), F.asc("role"))
    best = scored.withColumn("place", F.row_number().over(order)).where(c("place") <= k)
    lacking = F.array_except("required", F.col("own.skill"))
    best = best.join(parts.select("id", "own"), "id").join(near(totals.select("role", "required")), "role")
    return best.select("id", "role", "overall", *[F.round(n, 1).alias(n) for n in WEIGHTS], "place", lacking.alias("missing"))


def confusion(pairs: DataFrame, score: str, label: str, match: float = 70, partial: float = 55) -> DataFrame:
    """Three bands of a score against labels, and the absolute error to the middle of the labelled band."""
    band = F.when(F.col(score) >= match, "match").when(F.col(score) >= partial, "partial").otherwise("mismatch")
    middle = F.when(F.col(label) == "match", (match + 100) / 2).when(F.col(label) == "partial", (partial + match) / 2).otherwise(partial / 2)
    return pairs.groupBy(F.col(label).alias("label"), band.alias("band")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.abs(F.col(score) - middle)), 4).alias("error"))


def with_prerequisites(df: DataFrame, id_col: str, skills: str, prerequisites: DataFrame) -> DataFrame:
    """(id_col, skills): the skills of each row in order, each behind its direct prerequisites, every name once.

    ``prerequisites`` has (skill, place, prerequisite). A row without skills gets the general
    stages of :data:`GENERAL_STAGES`.
    """
    direct = prerequisites.groupBy("skill").agg(F.transform(F.sort_array(F.collect_set(F.struct("place", "prerequisite"))), lambda x: x["prerequisite"]).alias("before"))
    each = df.select(id_col, F.posexplode(skills).alias("k", "skill")).join(direct, "skill", "left")
    steps = F.concat(F.coalesce("before", F.array().cast("array<string>")), F.array("skill"))
    ordered = each.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("k", steps.alias("s")))).alias("l")).select(id_col, F.array_distinct(F.flatten("l.s")).alias("steps"))
    general = F.array(*[F.lit(s) for s in GENERAL_STAGES])
    return df.select(id_col).join(ordered, id_col, "left").select(id_col, F.coalesce("steps", general).alias("skills"))


def learning_plan(df: DataFrame, id_col: str, skills: Column, weeks: Column, hours: Column) -> DataFrame:
    """(id_col, stage, skill, tier, priority, first_week, last_week, hours): weeks shared out over skills and a final project.

    Weeks are held within 1 to 52, hours within 1 to 40; the number of stages follows from the
    weeks, the last stages take the remainder. Tier and priority follow from the stage's place.
    """
    w, h = F.least(F.greatest(weeks, F.lit(1)), F.lit(52)), F.least(F.greatest(hours, F.lit(1)), F.lit(40))
    stages = F.when(w >= 16, 7).when(w >= 10, 6).when(w >= 6, 5).otherwise(F.greatest(F.lit(2), w))
    df = df.select(id_col, F.array_distinct(skills).alias("all"), w.alias("w"), h.alias("h"), stages.alias("target")).where(F.size("all") > 0)
    kept = F.greatest(F.lit(1), F.least(F.col("target") - F.when(F.col("w") > 1, 1).otherwise(0), F.size("all")))
    named = F.concat(F.slice("all", 1, kept), F.when(F.col("w") > 1, F.array(F.lit(PROJECT_STAGE))).otherwise(F.expr("cast(array() as array<string>)")))
    df = df.select(id_col, "w", "h", named.alias("s")).withColumn("n", F.size("s"))
    df = df.withColumn("base", F.greatest(F.lit(1), F.floor(F.col("w") / F.col("n")))).withColumn("rest", F.greatest(F.lit(0), F.col("w") - F.col("base") * F.col("n")))
    each = df.select(id_col, "w", "h", "n", "base", "rest", F.posexplode("s").alias("k", "skill"))
    late = F.greatest(F.lit(0), F.col("k") - (F.col("n") - F.col("rest")))
    first = F.col("k") * F.col("base") + late + 1
    size = F.col("base") + F.when(F.col("k") >= F.col("n") - F.col("rest"), 1).otherwise(0)
    last = F.when(F.col("k") == F.col("n") - 1, F.col("w")).otherwise(F.least(F.col("w"), first + size - 1))
    tier = F.when(F.col("k") == 0, TIERS[0]).when(F.col("k") == 1, TIERS[1]).when(F.col("k") == F.col("n") - 1, TIERS[4]).when(F.col("k") == F.col("n") - 2, TIERS[3]).otherwise(TIERS[2])
    priority = F.when(F.col("k") <= 1, "P0").when(F.col("skill") == PROJECT_STAGE, "P2").otherwise("P1")
    planned = each.select(id_col, (F.col("k") + 1).alias("stage"), "skill", tier.alias("tier"), priority.alias("priority"), first.alias("first_week"), last.alias("last_week"), F.greatest(F.col("h"), (last - first + 1) * F.col("h")).alias("hours"))
    return planned.where(F.col("first_week") <= F.col("last_week"))
