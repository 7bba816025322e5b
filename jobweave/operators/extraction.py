"""Skills in texts by a dictionary, and how well an extraction agrees with another."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.functions.measures import double
from jobweave.operators.governance import requirement_confidence, requirement_type
from jobweave.sources.scratch import cut, spread

BEFORE, AFTER = 45, 65
MENTIONS = "array<struct<skill_id bigint, place int, evidence string>>"


def dictionary(skills: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(skill_id, alias, rank): canonical names first, then aliases (row_id, item_pos, item_value), lower-cased.

    Names of one character, and of two ASCII letters or digits, are too short to be looked for.
    """
    own = skills.select(F.col("id").alias("skill_id"), F.col("canonical_name").alias("alias"), F.lit(0).cast("long").alias("rank"))
    if aliases is not None:
        own = own.unionByName(aliases.select(F.col("row_id").alias("skill_id"), F.col("item_value").alias("alias"), F.col("item_pos").alias("rank")))
    named = own.where("alias is not null").withColumn("alias", F.lower(F.trim("alias")))
    usable = (F.length("alias") >= 2) & ~F.col("alias").rlike("^[a-z0-9]{1,2}$")
    return named.where(usable).groupBy("skill_id", "alias").agg(F.min("rank").alias("rank"))


def skill_mentions(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, limit: int = 50_000) -> DataFrame:
    """(id_col, skill_id, place, evidence, kind, confidence): skills whose name or alias occurs in a text.

    Of each skill the first alias in dictionary order counts, at its first place (from 1),
    with the text around it. Up to ``limit`` names one automaton goes over each text once; a
    larger dictionary stays distributed and meets the texts over pairs of characters
    (:func:`_joined_mentions`). ``texts`` is a scan or a projection of one.
    """
    texts = spread(texts.where(F.length(text_col) > 0).select(F.col(id_col), F.lower(text_col).alias("__t")))
    if names.limit(limit + 1).count() <= limit:
        entries: dict[str, list[tuple[int, int]]] = {}
        for r in names.collect():  # at most `limit` names
            entries.setdefault(r["alias"], []).append((r["skill_id"], r["rank"]))
        hits = texts.select(F.col(id_col), F.explode(F.pandas_udf(_looker(entries), MENTIONS)("__t")).alias("m")).select(id_col, "m.*")
    else:
        hits = _joined_mentions(texts, names, id_col)
    return hits.withColumns({"kind": requirement_type(F.col("evidence")), "confidence": requirement_confidence(F.col("evidence"))})


def _joined_mentions(texts: DataFrame, names: DataFrame, id_col: str) -> DataFrame:
    """The same without the driver: a text and an alias meet where the text holds the alias's rarest pair of characters."""
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda k: F.substring(c, k, F.lit(2))))
    keyed = texts.where(F.length("__t") >= 2).withColumn("__row", F.monotonically_increasing_id())
    keyed = cut(keyed)  # row numbers must not change between the two uses
    posted = keyed.select("__row", F.explode(pairs(F.col("__t"))).alias("pair"))
    aliases = names.select("alias").distinct().select("alias", F.explode(pairs(F.col("alias"))).alias("pair"))
    common = posted.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    rarest = aliases.join(common, "pair").groupBy("alias").agg(F.min(F.struct("n", "pair"))["pair"].alias("pair"), F.count(F.lit(1)).alias("known"))
    whole = rarest.join(names.select("alias").distinct().select("alias", F.size(pairs(F.col("alias"))).alias("all")), "alias").where("known = all")
    met = posted.join(whole.select("alias", "pair"), "pair").select("__row", "alias")
    placed = met.join(keyed, "__row").withColumn("place", F.position(F.col("alias"), F.col("__t"))).where("place > 0")
    start = F.greatest(F.lit(1), F.col("place") - BEFORE)
    evidence = F.trim(F.substring("__t", start, F.col("place") + F.length("alias") + AFTER - start))
    found = placed.select("__row", id_col, "alias", "place", evidence.alias("evidence")).join(names, "alias")
    best = found.groupBy("__row", "skill_id").agg(F.min(F.struct("rank", "alias", id_col, "place", "evidence")).alias("b"))
    return best.select(F.col(f"b.{id_col}").alias(id_col), "skill_id", "b.place", "b.evidence")


def _looker(entries: dict[str, list[tuple[int, int]]]):
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for alias in entries:
            automaton.add_word(alias, alias)
        automaton.make_automaton()
        for batch in batches:
            yield pd.Series([_mentions(t, automaton, entries) if t and entries else [] for t in batch])

    return look


def _mentions(text: str, automaton: ahocorasick.Automaton, entries: dict[str, list[tuple[int, int]]]) -> list[dict]:
    first: dict[str, int] = {}
    for end, alias in automaton.iter(text):
        first.setdefault(alias, end + 1 - len(alias))
    best: dict[int, tuple[int, str, int]] = {}
    for alias, at in first.items():
        for skill, rank in entries[alias]:
            if skill not in best or (rank, alias) < best[skill][:2]:
                best[skill] = (rank, alias, at)
    return [{"skill_id": s, "place": at + 1, "evidence": text[max(0, at - BEFORE) : at + len(alias) + AFTER].strip(" ")} for s, (_, alias, at) in sorted(best.items())]


def agreement(found: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Micro precision, recall and F1 of one set of keys against another, in one aggregation."""
    both = found.select(*keys).distinct().withColumn("f", F.lit(1)).join(gold.select(*keys).distinct().withColumn("g", F.lit(1)), keys, "full_outer")
    counted = both.agg(F.count_if(F.col("f").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return counted.select("tp", "fp", "fn", F.round(F.coalesce(p, F.lit(0.0)), 6).alias("precision"), F.round(F.coalesce(r, F.lit(0.0)), 6).alias("recall"), F.round(f1, 6).alias("f1"))


def knowledge_base(skills: DataFrame, jobs: DataFrame) -> DataFrame:
    """Evidence of each role, skill and kind, accumulated over postings in id order.

    Confidence starts at 0.84 (required) or 0.72 and rises by 0.02 per further posting, by
    0.005 where that one is a duplicate, up to 0.99.
    """
    ok = jobs.where((F.col("valid_for_analysis") == 1) & (F.col("is_deleted") == 0)).select("raw_job_id", F.trim("title_standard").alias("role_name"), F.trim(F.substring_index("source_name", "|", 1)).alias("channel"), "published_at", "governance_status")
    kind = F.upper(F.coalesce("requirement_type", F.lit("")))
    named = skills.where("skill_name is not null").select("raw_job_id", "skill_name", F.when(kind.isin("BONUS", "PREFERRED"), "BONUS").when(kind == "MENTIONED", "MENTIONED").otherwise("REQUIRED").alias("kind"))
    rows = named.distinct().join(ok.where("role_name <> ''"), "raw_job_id")
    step = F.when(F.col("governance_status") == "DUPLICATE_REVIEW", 0.005).otherwise(0.02)
    grouped = rows.groupBy("role_name", "skill_name", "kind").agg(
        F.count(F.lit(1)).alias("evidence_count"), F.countDistinct("channel").alias("source_count"), F.sum(step).alias("steps"), F.min_by(step, "raw_job_id").alias("first_step"),
        F.min("published_at").cast("string").alias("first_seen"), F.max("published_at").cast("string").alias("last_seen"),
    )
    base = F.when(F.col("kind") == "REQUIRED", 0.84).otherwise(0.72)
    return grouped.select("role_name", "skill_name", "kind", "evidence_count", "source_count", F.round(F.least(F.lit(0.99), base + F.col("steps") - F.col("first_step")), 6).alias("confidence"), "first_seen", "last_seen")


def confidence_bands(skills: DataFrame) -> DataFrame:
    """Relations per origin and confidence band."""
    band = F.when(double("confidence") >= 0.9, "high").when(double("confidence") >= 0.8, "middle").when(F.col("confidence").isNotNull(), "low").otherwise("none")
    return skills.groupBy(F.coalesce("origin_type", F.lit("")).alias("origin"), band.alias("band")).agg(F.count(F.lit(1)).alias("rows"))
