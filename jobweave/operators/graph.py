"""Role-skill graph over governed postings: nodes, edges, panorama, neighbourhoods, retrieval.

Roles are keyed by title, stack and level. Edges come from one aggregation over the joined
relation; nodes are aggregated from edges, so the large tables are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions.measures import analysable, double, evidence, filled, saturation
from jobweave.operators.market import BONUS_TYPES, titled, with_jobs
from jobweave.sources.scratch import cut

ROLE_KEY = ("role_name", "tech_stack", "level_name")
ROLE_FULL, SKILL_FULL, EDGE_FULL = 500, 120, 100
NO_STACK, NO_LEVEL = "未分类", "未标注"


def _labels() -> list[Column]:
    return [F.trim("title_standard").alias("role_name"), filled("tech_stack", NO_STACK).alias("tech_stack"), filled("level_name", NO_LEVEL).alias("level_name")]


def role_nodes(jobs: DataFrame, where: Column | None = None) -> DataFrame:
    """Roles with their postings, weight, mean quality and importance."""
    rows = jobs.where(analysable() & titled() & (F.lit(True) if where is None else where))
    grouped = rows.select(*_labels(), double("duplicate_weight").alias("w"), double("quality_score").alias("q")).groupBy(*ROLE_KEY)
    counted = grouped.agg(F.count(F.lit(1)).alias("sample_count"), F.round(F.sum("w"), 4).alias("weight"), F.round(F.avg("q"), 6).alias("confidence"))
    return counted.withColumn("importance", F.round(saturation(F.col("sample_count"), ROLE_FULL), 6))


def edges(skills: DataFrame, jobs: DataFrame, where: Column | None = None) -> DataFrame:
    """Role-skill relations with evidence, weights by kind and the kind that prevails."""
    joined = with_jobs(skills, jobs, analysable() & titled() & (F.lit(True) if where is None else where), "title_standard", "tech_stack", "level_name")
    required = F.when(F.col("kind") == "REQUIRED", F.col("support")).otherwise(F.lit(0.0))
    bonus = F.when(F.col("kind").isin(*BONUS_TYPES), F.col("support")).otherwise(F.lit(0.0))
    grouped = joined.select(*_labels(), "skill_name", "duplicate_group", "raw_job_id", "skill_stack", "category", double("confidence").alias("c"), "support", required.alias("r"), bonus.alias("b"))
    summed = grouped.groupBy(*ROLE_KEY, "skill_name").agg(
        F.count(F.lit(1)).alias("evidence_count"), evidence().alias("evidence_distinct"), F.round(F.sum("support"), 4).alias("support_weight"), F.round(F.sum("r"), 4).alias("required_weight"),
        F.round(F.sum("b"), 4).alias("bonus_weight"), F.round(F.avg("c"), 6).alias("confidence"), F.max("skill_stack").alias("skill_stack"), F.max("category").alias("category"),
    )
    kind = F.when((F.col("required_weight") <= 0) & (F.col("bonus_weight") <= 0), "MENTIONED").when(F.col("required_weight") >= F.col("bonus_weight"), "REQUIRED").otherwise("BONUS")
    return summed.withColumn("relation", kind).withColumn("weight", F.round(saturation(F.col("support_weight"), EDGE_FULL), 6))


def skill_nodes(relation: DataFrame) -> DataFrame:
    """Skills rolled up from edges."""
    rolled = relation.groupBy("skill_name").agg(
        F.round(F.sum("support_weight"), 4).alias("support_weight"), F.round(F.sum("required_weight"), 4).alias("required_weight"), F.round(F.sum("bonus_weight"), 4).alias("bonus_weight"),
        F.sum("evidence_count").alias("evidence_count"), F.count(F.lit(1)).alias("role_count"), F.round(F.avg("confidence"), 5).alias("confidence"), F.max("category").alias("category"),
    )
    return rolled.withColumn("importance", F.round(saturation(F.col("support_weight"), SKILL_FULL), 5))


def summary(roles: DataFrame, relation: DataFrame) -> DataFrame:
    """Counts of nodes and edges by kind; roles without an edge are left out."""
    kept = roles.join(relation.select(*ROLE_KEY).distinct(), list(ROLE_KEY), "left_semi").agg(F.count(F.lit(1)).alias("roles"))
    counted = relation.agg(
        F.countDistinct("skill_name").alias("skills"), F.count(F.lit(1)).alias("edges"), F.count_if(F.col("relation") == "REQUIRED").alias("required"),
        F.count_if(F.col("relation") == "BONUS").alias("bonus"), F.count_if(F.col("relation") == "MENTIONED").alias("mentioned"), F.round(F.avg("confidence"), 5).alias("mean_confidence"),
    )
    return kept.crossJoin(counted)  # one row each


def stack_distribution(roles: DataFrame) -> DataFrame:
    return roles.groupBy("tech_stack").agg(F.count(F.lit(1)).alias("roles"), F.sum("sample_count").alias("samples"))


def panorama(skills: DataFrame, jobs: DataFrame, role_limit: int = 24, edge_limit: int = 200, min_evidence: int = 1, stack: str | None = None, level: str | None = None) -> DataFrame:
    """Edges of the most frequent roles, of one ``stack`` or ``level`` where stated: roles are chosen first, then only their postings meet the skills."""
    if stack:
        jobs = jobs.where(filled("tech_stack", NO_STACK) == stack)
    if level:
        jobs = jobs.where(filled("level_name", NO_LEVEL) == level)
    top = cut(role_nodes(jobs).orderBy(F.desc("sample_count"), *ROLE_KEY).limit(role_limit).select(*ROLE_KEY))
    keyed = jobs.where(analysable() & titled()).withColumns({"__r": F.trim("title_standard"), "__t": filled("tech_stack", NO_STACK), "__l": filled("level_name", NO_LEVEL)})
    small = F.broadcast(top)  # at most role_limit rows
    chosen = keyed.join(small, (F.col("__r") == top["role_name"]) & (F.col("__t") == top["tech_stack"]) & (F.col("__l") == top["level_name"]), "left_semi").drop("__r", "__t", "__l")
    relation = edges(skills, chosen).where(F.col("evidence_count") >= min_evidence)
    return relation.orderBy(F.desc("support_weight"), *ROLE_KEY, "skill_name").limit(edge_limit)


def top_neighbours(relation: DataFrame, k: int = 16) -> DataFrame:
    w = Window.partitionBy(*ROLE_KEY).orderBy(F.desc("evidence_count"), F.asc("skill_name"))
    return relation.select(*ROLE_KEY, "skill_name", "evidence_count", F.row_number().over(w).alias("place")).where(F.col("place") <= k)


def expand(relation: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(node, hops): nodes reached from ``seeds`` over undirected role-skill edges, with the fewest hops.

    The frontier of each round meets the edges once and is cut, so that the plan stays short.
    """
    both = relation.select(F.concat(F.lit("R:"), "role_name").alias("a"), F.concat(F.lit("S:"), "skill_name").alias("b")).distinct()
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    reached = cut(seeds.select(F.col("node"), F.lit(0).alias("hops")).distinct())
    frontier = reached
    for hop in range(1, hops + 1):
        step = both.join(frontier.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        frontier = cut(step.join(reached, "node", "left_anti").withColumn("hops", F.lit(hop)))
        reached = reached.unionByName(frontier)
    return reached


def retrieve(relation: DataFrame, question: str) -> DataFrame:
    """Roles and their strongest relations for a question that names a role or a skill of two or more characters."""
    q = F.lit(question.lower())
    named = (F.length("role_name") >= 2) & F.contains(q, F.lower("role_name")) | (F.length("skill_name") >= 2) & F.contains(q, F.lower("skill_name"))
    w = Window.partitionBy("role_name").orderBy(F.desc("support_weight"), F.asc("skill_name"), F.asc("tech_stack"), F.asc("level_name"))
    hits = relation.where(named).select(*ROLE_KEY, "skill_name", "relation", "support_weight", F.row_number().over(w).alias("place"))
    return hits.where("place <= 8")


def quality(nodes: DataFrame) -> DataFrame:
    """(nodes, quality): the mean confidence of the nodes, of a hundred."""
    return nodes.agg(F.count(F.lit(1)).alias("nodes"), F.round(F.avg("confidence") * 100, 2).alias("quality"))
