"""Comparing phrases with the text they should come from, and small text and key functions around it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave.functions.text import HTML, jtrim, nfkc, spaces, tokens

# What a question is cleared of, terms too general to search for, labels of lists.
LATIN_TERM = r"[A-Za-z][A-Za-z0-9+#.\-]{1,30}"
GENERAL_TERMS = ("agent", "rag", "api")
ASKING = r"(请问|帮我|我想知道|当前|最近|目前|系统中|数据中|有哪些|有什么|哪些|多少|如何|怎么|为什么|是否|可以|需要|要求|发现了|发现|岗位|职位|工作|技能|能力|变化|新增|减少|趋势|情况|数据|分析|一下|新的|新)"
LIST_LABEL = r"(?i)(matched|missing|skills|suggestions|required|bonus|skill_name|name)\s*[:=]"
OMITTED = "\n\n……中间过长内容已省略，以下为简历尾部……\n\n"
SHORT_ADVERT = r"招聘热线[:：]?\S+|点击申请|立即沟通|福利待遇[:：]?"


def match_form(value: Column) -> Column:
    """Lower case without blanks, underscores, hyphens, middle dots and slashes; null becomes empty."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[\s_\-·/]+", "")


def evidence_form(value: Column, folded: bool = True) -> Column:
    """Lower case without blanks and separators; ``folded`` adds the compatibility form."""
    text = F.coalesce(value, F.lit(""))
    return F.regexp_replace(F.lower(nfkc(text) if folded else text), r"[\s_\-./|｜、，,;；:：()（）]+", "")


def clean_phrase(value: Column) -> Column:
    """Without leading separators, blanks single."""
    return spaces(F.regexp_replace(F.coalesce(value, F.lit("")), r"^[：:、,，\-\s]+", ""))


def grounded(phrase: Column, text: Column) -> Column:
    """Whether a phrase of 4 to 80 characters stands in a text (6 or more match characters) or shares 55 % of its words with it."""
    clean = clean_phrase(phrase)
    short, whole = match_form(clean), match_form(text)
    words = tokens(clean)
    shared = F.size(F.array_intersect(words, tokens(F.coalesce(text, F.lit("")))))
    told = (F.length(short) >= 6) & F.contains(whole, short)
    return F.length(clean).between(4, 80) & (told | ((F.size(words) > 0) & (shared >= 0.55 * F.size(words))))


def anchored(whole: Column, part: Column) -> Column:
    """Whether evidence of 6 or more characters, or a piece of 24 of it (every 12), stands in the text; both in :func:`evidence_form`."""
    size = F.least(F.lit(24), F.length(part))
    last = F.length(part) - size + 1
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.greatest(F.lit(6), F.floor(size / 2).cast("int"))), lambda k: F.substring(part, k, size))
    return (F.length(part) >= 6) & (F.contains(whole, part) | F.exists(pieces, lambda p: (F.length(p) >= 8) & F.contains(whole, p)))


def clipped(value: Column, most: int) -> Column:
    """At most ``most`` characters of the text with single blanks, an ellipsis behind what was cut."""
    text = spaces(F.coalesce(value, F.lit("")))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most), r"[，,；;、\s]+$", ""), F.lit("…")))


def abbreviated(value: Column, most: int) -> Column:
    return F.substring(spaces(F.coalesce(value, F.lit(""))), 1, most)


def head_and_tail(value: Column, most: int = 4000, share: float = 0.72) -> Column:
    """A long text as its first 72 % and its end, ``most`` characters together, with a note between."""
    text = jtrim(F.coalesce(value, F.lit("")))
    head = int(most * share)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(OMITTED), F.substring(text, -(most - head), most - head)))


def listed(value: Column, most: int) -> Column:
    """Up to ``most`` different items of a loosely written list: brackets, quotes and labels off, items up to 60 characters."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\[\]{}\"']", " "), LIST_LABEL, " ")
    items = F.transform(F.split(spaces(text), r"[、,，;；/\n]+"), lambda i: F.trim(i))
    return F.slice(F.array_distinct(F.filter(items, lambda i: (i != "") & (F.length(i) <= 60))), 1, most)


def question_terms(question: Column, most: int = 3) -> Column:
    """Up to ``most`` terms worth searching for: Latin words, then runs of 2 to 12 Han characters that are no asking words."""
    latin = F.transform(F.regexp_extract_all(question, F.lit(LATIN_TERM), F.lit(0)), F.lower)
    latin = F.slice(F.array_distinct(F.filter(latin, lambda t: ~t.isin(*GENERAL_TERMS))), 1, most)
    rest = F.regexp_replace(F.regexp_replace(question, LATIN_TERM, " "), ASKING, " ")
    runs = F.filter(F.split(F.regexp_replace(rest, r"[^\p{IsHan}]+", " "), " "), lambda r: F.length(r).between(2, 12))
    return F.slice(F.array_distinct(F.concat(latin, runs)), 1, most)


def percent(value: Column) -> Column:
    """A share as a percentage with one decimal."""
    return F.concat(F.format_string("%.1f", F.round(value * 1000) / 10), F.lit("%"))


def points(value: Column) -> Column:
    """A difference of percentages with its sign."""
    rounded = F.round(value, 1)
    return F.concat(F.when(rounded >= 0, "+").otherwise(""), F.format_string("%.1f", rounded), F.lit("pp"))


def demo_clean(value: Column) -> Column:
    """The short cleaning of imported documents: markup and adverts out, blanks and empty lines reduced."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), HTML, " "), SHORT_ADVERT, " ")
    return jtrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[\t\r]+", " "), r"[ ]{2,}", " "), r"\n{3,}", "\n\n"))


def edited_template(value: Column) -> Column:
    """Fingerprint text of an edited description; other than that of a load it keeps boiler-plate words."""
    text = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"\d+(?:\.\d+)?", "#")
    return spaces(F.regexp_replace(text, r"[^a-z0-9\x{4e00}-\x{9fff}+#.]", " "))


def fenced_json(value: Column) -> Column:
    """The object between the first and the last brace of a text, null without one."""
    return F.nullif(F.regexp_extract(value, r"(?s)(\{.*\})", 1), F.lit(""))


def json_items(value: Column) -> Column:
    """A JSON list as an array of strings; anything else is an empty list."""
    return F.coalesce(F.from_json(value, "array<string>"), F.expr("cast(array() as array<string>)"))


def stable_key(*parts: Column) -> Column:
    """Key of several values: hash of them with a unit separator between."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def stable_id(prefix: str, value: Column) -> Column:
    """The name-based identifier (version 3) of a prefix and a value."""
    digest = F.md5(F.concat(F.lit(prefix + "\x00"), value).cast("binary"))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.lit(prefix + "-"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def freshness(day: Column, as_of: Column) -> Column:
    """1 on the day itself, falling to a quarter over two years; unknown days stay unknown."""
    return F.when(day.isNotNull(), F.greatest(F.lit(0.25), 1 - F.abs(F.datediff(as_of, day)) / 730.0))


def clamped_run(changes: Column, start: float = 50.0, factor: float = 1.6, low: float = 12.0, high: float = 88.0) -> Column:
    """The running score of an ordered array of changes, kept within ``low`` and ``high`` at every step."""
    step = lambda a, x: F.concat(a, F.array(F.round(F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.element_at(a, -1), F.lit(start)) + x * factor)), 6)))
    return F.aggregate(changes, F.expr("cast(array() as array<double>)"), lambda a, x: F.when(F.size(a) == 0, F.array(F.round(F.greatest(F.lit(low), F.least(F.lit(high), F.lit(start) + x * factor)), 6))).otherwise(step(a, x)))


def answer_confidence(evidence: Column, answered: Column, warnings: Column) -> Column:
    """Confidence of an answer from the number of evidence rows and warnings and whether a model wrote it."""
    base = F.when(answered, 0.86).otherwise(0.58) + F.when(evidence >= 4, 0.04).otherwise(0.0) + F.when(warnings == 0, 0.04).otherwise(0.0)
    return F.when(evidence == 0, 0.25).otherwise(F.least(F.lit(0.94), F.round(base, 6)))


def opportunity(confidence: Column, novelty: Column, growth: Column, risk: Column) -> Column:
    """0 to 99 out of confidence, novelty, growth and the absence of risk."""
    known = [F.coalesce(c, F.lit(0.0)) for c in (confidence, novelty, growth, risk)]
    return F.least(F.lit(99), F.greatest(F.lit(0), F.round((known[0] * 0.36 + known[1] * 0.28 + known[2] * 0.24 + (1 - known[3]) * 0.12) * 100).cast("int")))


def risk_level(risk: Column) -> Column:
    return F.when(risk >= 0.35, "HIGH").when(risk >= 0.18, "REVIEW").otherwise("LOW")
