"""Queries of problems 1, 3, 6 and 7: survivors, near-duplicates, look-alike text, canonical values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.canonical import match_values
from jobweave.llm.near_duplicates import expand_pairs, similar_groups, similar_pairs
from jobweave.llm.skeleton import equal_looking, looking_alike, with_forms
from jobweave.llm.survivors import FILLERS, group_members, surviving_values, survivors
from jobweave.sources.tables import table

FIELDS = ("city", "education", "experience_text", "industry", "salary_min")
TEXTS = ["title", "company", "description"]


def _survivors(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["duplicate_group", "raw_job_id", "source_name", "published_at", "quality_score", "is_deleted", *FIELDS]
    governed = table(spark, folder, "governed").select(*columns)
    members = group_members(governed, "duplicate_group", F.col("is_deleted") == 0)
    return surviving_values(members, table(spark, folder, "source_trust"), FIELDS)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """(duplicate_group, field_name, raw_job_id): where the surviving value of each field comes from."""
    return _survivors(spark, folder).select("duplicate_group", "field_name", "raw_job_id")


def p1_records(spark: SparkSession, folder: str) -> DataFrame:
    """One surviving record per duplicate group, each value with its origin."""
    return survivors(_survivors(spark, folder), FIELDS)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """(id_a, id_b): postings whose descriptions are alike to at least 0.6, exact copies included."""
    raw = table(spark, folder, "raw_job").select("id", "description")
    return expand_pairs(*similar_pairs(raw, "id", "description")).distinct()


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """(id, group_id, copies, links) of every posting with a comparable description."""
    raw = table(spark, folder, "raw_job").select("id", "description")
    return similar_groups(*similar_pairs(raw, "id", "description"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """(id, field_name): texts of postings with characters that stand in for others or cannot be seen."""
    raw = table(spark, folder, "raw_job").select("id", *TEXTS)
    return looking_alike(raw, "id", TEXTS).select("id", "field_name")


def p6_plain(spark: SparkSession, folder: str) -> DataFrame:
    """(id, field_name, plain, stand_ins): every text of the postings in its one form."""
    raw = table(spark, folder, "raw_job").select("id", *TEXTS)
    return with_forms(raw, "id", TEXTS).select("id", "field_name", "plain", "stand_ins")


def p6_companies(spark: SparkSession, folder: str) -> DataFrame:
    """(skeleton, plain, spellings, rows): company names that look alike, grouped."""
    return equal_looking(table(spark, folder, "raw_job").select("company"), "company")


def p6_titles(spark: SparkSession, folder: str) -> DataFrame:
    """(skeleton, plain, spellings, rows): titles that look alike, grouped."""
    return equal_looking(table(spark, folder, "raw_job").select("title"), "title")


def p6_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """(skeleton, plain, spellings, rows): descriptions that look alike, grouped."""
    return equal_looking(table(spark, folder, "raw_job").select("description"), "description")


# Titles that mean no listed role score up to 0.41, misspelt ones from 0.44 (measured at sf0.1).
ROLE_THRESHOLD, ROLE_MARGIN = 0.43, 0.01


def _roles(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    titles = table(spark, folder, "governed").select("raw_job_id", "title_raw").where(F.trim("title_raw") != "")
    roles = table(spark, folder, "job_role").select("id", "role_name")
    return titles, match_values(titles, "title_raw", roles, "id", "role_name", ROLE_THRESHOLD, ROLE_MARGIN)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """(raw_job_id, role_id): the role each title means, or 0."""
    titles, matched = _roles(spark, folder)
    return titles.join(matched.select("title_raw", "entry"), "title_raw", "left").select("raw_job_id", F.coalesce("entry", F.lit(0)).alias("role_id"))


def p7_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """(title_raw, rows, nearest, score, runner_up): different titles that mean no listed role."""
    return _roles(spark, folder)[1].where("entry is null").select("title_raw", "rows", "nearest", "score", "runner_up")


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p3_found, p3_groups, p6_found, p6_plain, p6_companies, p6_titles, p6_descriptions, p7_found, p7_unmatched)}

_FILLERS = ", ".join("'" + x.replace("'", "''") + "'" for x in FILLERS)
_BLANK = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_TRIM = lambda c: f"regexp_replace({c}, '^{_BLANK}|{_BLANK}$', '', 'g')"
_P1 = f"""
WITH rows AS (
  SELECT g.*, t.rk FROM zhitu_governed_job g
  LEFT JOIN (SELECT lower({_TRIM('source_name')}) AS s, min(trust_rank) AS rk FROM source_trust GROUP BY 1) t ON lower({_TRIM('g.source_name')}) = t.s
  WHERE is_deleted = 0 AND coalesce({_TRIM('duplicate_group')}, '') <> ''
    AND duplicate_group IN (SELECT duplicate_group FROM zhitu_governed_job WHERE is_deleted = 0 GROUP BY 1 HAVING count(*) > 1)
), tall AS (
  {" UNION ALL ".join(f"SELECT duplicate_group, raw_job_id, rk, published_at, quality_score, '{f}' AS field_name, CAST({f} AS VARCHAR) AS value FROM rows" for f in FIELDS)}
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY duplicate_group, field_name ORDER BY rk ASC NULLS LAST, published_at DESC NULLS LAST, quality_score DESC NULLS LAST, raw_job_id ASC) AS k
  FROM tall WHERE value IS NOT NULL AND {_TRIM('value')} <> '' AND lower({_TRIM('value')}) NOT IN ({_FILLERS})
)
"""
SQL = {
    "p1_found": _P1 + "SELECT duplicate_group, field_name, raw_job_id FROM ranked WHERE k = 1",
    "p1_records": _P1
    + "SELECT duplicate_group, "
    + ", ".join(f"max(CASE WHEN field_name = '{f}' THEN value END) AS {f}, max(CASE WHEN field_name = '{f}' THEN raw_job_id END) AS {f}_from" for f in FIELDS)
    + " FROM ranked WHERE k = 1 GROUP BY duplicate_group",
}
