"""How the skills of roles change between two years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.measures import analysable, clamp, evidence
from jobweave.operators.market import BONUS_TYPES, titled, with_jobs

# Words in a skill's name and the weight of its market.
MARKET = (
    (1.34, "大语言|llm|rag|agent|prompt|向量|langchain"), (1.18, "kubernetes|docker|devops|云|微服务|spring cloud"),
    (1.04, "mysql|sql|redis|kafka|数据库|flink"), (0.92, "vue|react|node|javascript|typescript"), (0.72, "office|excel|ppt"),
)


def java_hash(text: Column) -> Column:
    """The 32-bit string hash of Java over the characters of the basic plane, as a signed number."""
    start = F.lit(0).cast("bigint")
    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("bigint"))
    folded = F.aggregate(units, start, lambda h, u: F.pmod(h * 31 + u, F.lit(4294967296)))
    return F.when(folded >= 2147483648, folded - 4294967296).otherwise(folded)


def market_weight(skill: Column) -> Column:
    """By key words, else one of nine steps chosen by the hash of the name."""
    low = F.lower(F.coalesce(skill, F.lit("")))
    out = 0.88 + 0.035 * F.abs(java_hash(low) % 9)
    for weight, pattern in reversed(MARKET):
        out = F.when(low.rlike(pattern), F.lit(weight)).otherwise(out)
    return out


def skill_rates(skills: DataFrame, jobs: DataFrame, years: tuple[int, int], roles: int | None = 100) -> DataFrame:
    """Per role, skill and year: evidence, weights and the rate of support per posting.

    Roles are the ``roles`` most frequent of the later year (all without a number).
    """
    base = analysable() & titled() & F.col("published_year").isin(*years)
    counts = jobs.where(base).groupBy("published_year", "title_standard").agg(evidence().alias("role_count"))
    if roles is not None:
        top = counts.where(F.col("published_year") == max(years)).orderBy(F.desc("role_count"), F.asc("title_standard")).limit(roles).select("title_standard")
        counts = counts.join(F.broadcast(top), "title_standard", "left_semi")  # at most `roles` rows
    joined = with_jobs(skills, jobs, base, "title_standard", "published_year")
    part = lambda cond: F.sum(F.when(cond, F.col("support")).otherwise(F.lit(0.0)))
    summed = joined.groupBy("published_year", "title_standard", "skill_name").agg(
        evidence().alias("evidence"), F.sum("support").alias("support"), part(F.col("kind") == "REQUIRED").alias("required"), part(F.col("kind").isin(*BONUS_TYPES)).alias("bonus")
    )
    return summed.join(counts, ["published_year", "title_standard"]).withColumn("rate", F.col("support") / F.col("role_count"))


def changes(rates: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Added, modified and weakened skills with forecast step, risk and confidence.

    Both years of a pair come from one conditional aggregation over the rates, not from a join.
    """
    old, new = min(years), max(years)
    pick = lambda c, y: F.max(F.when(F.col("published_year") == y, F.col(c)))
    wide = rates.groupBy("title_standard", "skill_name").agg(*[pick(c, y).alias(f"{c}_{t}") for t, y in (("old", old), ("new", new)) for c in ("evidence", "support", "required", "bonus", "rate")])
    c = F.col
    had, has = c("evidence_old").isNotNull(), c("evidence_new").isNotNull()
    r_old, r_new = F.coalesce("rate_old", F.lit(0.0)), F.coalesce("rate_new", F.lit(0.0))
    kind = lambda t: F.when(c(f"required_{t}") >= c(f"bonus_{t}"), "REQUIRED").otherwise("BONUS")
    change = (
        F.when(~had & has & (c("evidence_new") >= 3) & (r_new >= 0.08), "ADDED")
        .when(had & has & (kind("old") != kind("new")) & (c("evidence_old") >= 3) & (c("evidence_new") >= 3), "MODIFIED")
        .when(had & (r_old >= 0.08) & (~has | (r_new <= r_old * 0.45)), "WEAKENED")
        .when(had & has & (r_new >= F.greatest(F.lit(0.12), r_old * 1.8)) & (c("evidence_new") >= 5), "ADDED")
    )
    found = wide.withColumns({"r_old": r_old, "r_new": r_new, "change": change}).where("change is not null")
    stated = lambda x: F.when(has, c(f"{x}_new")).otherwise(c(f"{x}_old"))
    found = found.withColumns({"e": stated("evidence"), "s": stated("support"), "q": stated("required"), "market": market_weight(c("skill_name"))})
    delta = (c("r_new") - c("r_old")) * 100
    by_evidence = F.least(F.lit(8.0), F.log1p(c("e").cast("double")) * 2.3)
    by_support = F.least(F.lit(6.0), F.log1p("s") * 1.3)
    by_required = F.when(c("s") > 0, clamp(c("q") / c("s"))).otherwise(F.lit(0.0)) * 5
    weaker = -clamp(F.greatest(F.lit(4.0), F.abs(delta) * (0.95 + 1 / F.greatest(F.lit(1.0), c("market"))) + by_evidence * 0.45), 3.0, 45.0)
    turn = F.when(has & had & (c("required_new") >= c("required_old")), 1.0).otherwise(-1.0)
    changed = turn * clamp(F.greatest(F.lit(2.0), F.abs(delta) * 0.55 + by_required + by_evidence * 0.25), 2.0, 24.0)
    added = clamp(F.greatest(delta, F.lit(2.0)) * c("market") + by_evidence + by_support * 0.45 + by_required * 0.35, 4.0, 45.0)
    step = F.when(c("change") == "WEAKENED", weaker).when(c("change") == "MODIFIED", changed).otherwise(added)
    risk_of = F.when(c("e") >= 8, 0.035).when(c("e") >= 5, 0.055).otherwise(0.08) + F.when(F.abs(c("r_new") - c("r_old")) >= 0.12, -0.012).otherwise(0.008)
    found = found.withColumn("risk", F.round(clamp(risk_of, 0.03, 0.095), 3))
    most = F.greatest(F.coalesce("evidence_new", F.lit(0)), F.coalesce("evidence_old", F.lit(0)))
    sure = clamp(F.greatest(F.lit(0.55), 1 - c("risk")) + F.least(F.lit(0.05), F.log1p(most.cast("double")) / 80))
    return found.select("title_standard", "skill_name", "change", F.round("r_old", 4).alias("old_rate"), F.round("r_new", 4).alias("new_rate"), most.alias("evidence"), F.round(step, 1).alias("forecast_delta"), "risk", F.round(sure, 4).alias("confidence"))
