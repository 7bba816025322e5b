"""Text functions as column expressions; only compatibility folding needs Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide results.
HTML = r"(?is)<script.*?</script>|<style.*?</style>|<[^>]+>"
CONTACT_LINE = r"(?i)(招聘热线|联系电话|联系方式|联系人|邮箱|email|微信|公众号)\s*[:：]?\s*\S+"
ADVERT = r"(?i)(点击申请|立即沟通|立即投递|收藏职位|举报职位|职位亮点|福利待遇[:：]?|公司福利[:：]?)"
TITLE_BRACKETS = r"[（(【\[].{0,40}?[）)】\]]"
TITLE_NOISE = r"(?i)(急聘|诚聘|高薪|直招|校招|社招|招聘|五险一金|双休|包吃住|\d+(?:\.\d+)?k[-~—]?\d*(?:\.\d+)?k?)"
TEMPLATE_WORDS = r"(公司|集团|科技|有限|招聘|岗位职责|任职要求|职位要求|职位描述)"
SHORT_BRACKETS = r"[（(【\[].{0,30}?[）)】\]]"
FORECAST_LEVELS = r"(?i)(初级|中级|高级|资深|专家|首席|助理|实习|校招|社招|急招|诚聘|junior|senior|sr\.?|jr\.?|lead|principal|staff)"
FORECAST_NOISE = r"(?i)(招聘|直招|高薪|双休|五险一金|\d+k[-~—]?\d*k?)"
FORECAST_SYNONYMS = (
    ("人工智能", "ai"), ("大语言模型", "大模型"), ("large language model", "llm"), ("machine learning", "机器学习"),
    ("deep learning", "深度学习"), ("后端", "backend"), ("前端", "frontend"),
)
JOB_SUFFIX = r"(?i)(开发工程师|研发工程师|算法工程师|软件工程师|工程师|开发岗|研发岗|专员|顾问|岗位|developer|engineer|specialist|consultant)$"


def jtrim(value: Column) -> Column:
    """Characters up to U+0020 off both ends."""
    return F.regexp_replace(value, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def spaces(value: Column) -> Column:
    return jtrim(F.regexp_replace(value, r"\s+", " "))


def _fold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFKC", v))


def nfkc(value: Column) -> Column:
    """Compatibility form; of plain ASCII only a null goes to Python."""
    return F.coalesce(F.pandas_udf(_fold, "string")(F.when(value.rlike(r"[^\x00-\x7F]"), value)), value)


def normalise(value: Column) -> Column:
    """Compatibility form, lower case, single blanks, trimmed; null stays null."""
    return spaces(F.lower(nfkc(value)))


def lowered(value: Column) -> Column:
    """As ``normalise`` without the compatibility form, within the JVM."""
    return spaces(F.lower(value))


def tokens(value: Column) -> Column:
    """Different words of more than one character, in order of appearance."""
    kept = F.regexp_replace(lowered(value), r"[^\p{L}\p{N}+#.]+", " ")
    return F.array_distinct(F.filter(F.split(kept, " "), lambda t: F.length(t) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def clean_description(value: Column, limit: int = 60_000) -> Column:
    """Markup, contact lines and adverts out, blanks and empty lines reduced; null becomes empty."""
    text = F.coalesce(value, F.lit(""))
    for pattern in (HTML, CONTACT_LINE, ADVERT):
        text = F.regexp_replace(text, pattern, " ")
    text = F.regexp_replace(F.translate(text, " ", " "), r"[\t\r]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"[ ]{2,}", " "), r"\n{3,}", "\n\n")
    return F.substring(jtrim(text), 1, limit)


def standard_title(value: Column) -> Column:
    text = F.regexp_replace(F.coalesce(value, F.lit("")), TITLE_BRACKETS, " ")
    text = F.regexp_replace(F.regexp_replace(text, TITLE_NOISE, " "), r"[|丨/\\]+", " ")
    return jtrim(F.substring(spaces(text), 1, 120))


def template_text(value: Column, limit: int = 2500) -> Column:
    """What a description has in common with others of its template: numbers and boiler-plate words gone."""
    text = F.lower(F.coalesce(value, F.lit("")))
    text = F.regexp_replace(F.regexp_replace(text, r"\d+(?:\.\d+)?", "#"), r"[a-f0-9]{16,}", "#")
    text = F.regexp_replace(F.regexp_replace(text, TEMPLATE_WORDS, " "), r"[^a-z0-9\x{4e00}-\x{9fff}+#.]", " ")
    return F.when(F.trim(F.coalesce(value, F.lit(""))) == "", F.lit("EMPTY")).otherwise(F.substring(spaces(text), 1, limit))


def forecast_title(value: Column, folded: bool = False) -> Column:
    """Title without level, noise and job suffix; synonyms replaced in their order. ``folded`` adds the compatibility form."""
    text = F.coalesce(value, F.lit(""))
    text = jtrim(F.lower(nfkc(text) if folded else text))
    for pattern in (SHORT_BRACKETS, FORECAST_LEVELS, FORECAST_NOISE):
        text = F.regexp_replace(text, pattern, " ")
    for word, other in FORECAST_SYNONYMS:
        text = F.replace(text, F.lit(word), F.lit(other))
    text = spaces(F.regexp_replace(text, r"[^a-z0-9\x{4e00}-\x{9fff}+#.]+", " "))
    return spaces(F.regexp_replace(text, JOB_SUFFIX, ""))


def bigrams(value: Column) -> Column:
    """Different pairs of neighbouring characters; a single character is its own gram."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(value) - 1), lambda k: F.substring(value, k, F.lit(2)))
    return F.when(F.length(value) <= 1, F.filter(F.array(value), lambda v: v != "")).otherwise(F.array_distinct(pairs))


def title_similarity(a: Column, b: Column) -> Column:
    """1 when equal, 0.98 without blanks, a share of the lengths when one holds the other, else that of common pairs."""
    ca, cb = F.replace(a, F.lit(" "), F.lit("")), F.replace(b, F.lit(" "), F.lit(""))
    la, lb = F.length(ca), F.length(cb)
    ratio = F.least(la, lb) / F.greatest(la, lb)
    ga, gb = bigrams(ca), bigrams(cb)
    return (
        F.when((F.trim(a) == "") | (F.trim(b) == "") | a.isNull() | b.isNull(), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when(ca == cb, F.lit(0.98))
        .when(F.contains(ca, cb) | F.contains(cb, ca), F.least(F.lit(1.0), 0.76 + 0.20 * ratio))
        .otherwise(F.size(F.array_intersect(ga, gb)) / F.size(F.array_union(ga, gb)))
    )


def sentences(value: Column) -> Column:
    """Pieces between full stops, semicolons, line ends and before list numbers, trimmed, blank ones out."""
    parts = F.split(value, r"[。；;\n]|(?=[0-9一二三四五六七八九十]{1,2}[、.．)）])")
    return F.filter(F.transform(parts, jtrim), lambda p: p != "")


def window_around(text: Column, place: Column, length: Column, before: int = 45, after: int = 65) -> Column:
    """Part of ``text`` from ``before`` characters ahead of ``place`` to ``after`` behind the hit."""
    start = F.greatest(F.lit(1), place - before)
    return F.trim(F.substring(text, start, place + length + after - start))
