"""Arbitrary posting columns -> one canonical projection, as a pure function of the schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names under which sources know each field; the first one present wins.
ALIASES: dict[str, tuple[str, ...]] = {
    "raw_id": ("id", "raw_id", "job_id", "数据id", "数据_id"),
    "raw_title": ("title", "job_title", "job_title_raw", "position_title", "position_name", "position", "job_name", "招聘岗位", "岗位名称", "职位名称", "职位", "岗位", "招聘职位"),
    "company": ("company", "company_name", "enterprise_name", "employer", "企业名称", "公司名称", "招聘单位", "单位名称"),
    "description": ("description", "job_description", "job_desc", "job_detail", "job_content", "content", "jd", "detail", "职位描述", "岗位描述", "工作描述", "招聘描述", "职位详情", "岗位职责"),
    "city": ("city", "work_city", "job_city", "工作城市", "城市", "工作地点", "公司地点"),
    "education": ("education", "education_requirement", "学历要求", "学历", "最低学历"),
    "experience": ("experience", "experience_requirement", "work_experience", "要求经验", "经验要求", "工作经验"),
    "source_name": ("source", "source_platform", "platform", "来源", "来源平台", "数据来源"),
    "industry": ("industry", "industry_name", "行业", "所属行业", "招聘类别", "初级分类"),
    "salary_min": ("salary_min", "min_salary", "最低月薪", "最低薪资", "薪资下限"),
    "salary_max": ("salary_max", "max_salary", "最高月薪", "最高薪资", "薪资上限"),
    "published_at": ("published_at", "publish_at", "publish_time", "publish_date", "published_date", "posting_date", "job_publish_date", "release_date", "招聘发布日期", "发布日期", "发布时间", "发布日", "招聘时间"),
    "published_year": ("published_year", "publish_year", "recruitment_year", "year", "posting_year", "招聘发布年份", "发布年份", "招聘年份", "年份"),
}
REQUIRED = ("raw_id", "raw_title", "description")
TEXTS = ("raw_title", "company", "description", "city", "education", "experience", "source_name", "industry")


def _key(name: str) -> str:
    return name.lower().replace("_", "").replace("-", "").replace(" ", "").strip()


def find_columns(names: Sequence[str], aliases: Mapping[str, Sequence[str]] = ALIASES) -> dict[str, str]:
    """Canonical field -> column of the source. Raises when a needed field has none."""
    present = {}
    for n in names:
        present.setdefault(_key(n), n)
    found = {field: next((present[_key(a)] for a in known if _key(a) in present), None) for field, known in aliases.items()}
    missing = [f for f in REQUIRED if not found.get(f)]
    if missing or not (found["published_at"] or found["published_year"]):
        raise ValueError(f"no column for {', '.join(missing) or 'a date or year of publication'}")
    return {f: c for f, c in found.items() if c}


def _text(column: str) -> Column:
    return F.coalesce(F.trim(F.col(f"`{column}`").cast("string")), F.lit(""))


def _number(column: str) -> Column:
    return F.nullif(F.regexp_replace(F.col(f"`{column}`").cast("string"), r"[^0-9.]", ""), F.lit("")).try_cast("decimal(12,2)")


def _year_prefix(column: str) -> Column:
    return F.substring(F.trim(F.col(f"`{column}`").cast("string")), 1, 4).try_cast("int")


def canonical(df: DataFrame) -> DataFrame:
    """The thirteen canonical columns of ``df``; absent text fields are empty, absent numbers null."""
    c = find_columns(df.columns)
    text = {f: _text(c[f]).alias(f) if f in c else F.lit("").alias(f) for f in TEXTS}
    year = _year_prefix(c["published_year"]) if "published_year" in c else None
    first_day = F.make_date(F.when(year.between(1, 9999), year), F.lit(1), F.lit(1)) if year is not None else F.lit(None).cast("date")
    if "published_at" in c:
        ten = F.substring(F.trim(F.col(f"`{c['published_at']}`").cast("string")), 1, 10)
        day = lambda sep: F.when(ten.rlike(rf"^\d{{4}}{sep}\d{{2}}{sep}\d{{2}}$"), F.try_to_timestamp(ten, F.lit(f"yyyy{sep}MM{sep}dd")).cast("date"))
        date = F.coalesce(day("-"), day("/"), first_day)
    else:
        date = first_day
    return df.select(
        F.col(f"`{c['raw_id']}`").cast("long").alias("raw_id"),
        *[text[f] for f in TEXTS],
        *[(_number(c[f]) if f in c else F.lit(None).cast("decimal(12,2)")).alias(f) for f in ("salary_min", "salary_max")],
        date.alias("published_at"),
        (year if year is not None else F.year(date)).alias("published_year"),
    )
