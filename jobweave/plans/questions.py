"""Questions to bounded query plans; nothing here touches data."""

from __future__ import annotations

import re

from jobweave.operators.market import QueryPlan

MAX_LIMIT = 10
# What a question must hold for each kind of plan, in order.
RULES = (
    ("SALARY_SUMMARY", r"薪资|薪酬|工资|月薪|年薪|salary|pay\b"),
    ("TOP_SKILLS", r"技能|能力要求|技术栈排行|skill"),
    ("TOP_CITIES", r"城市|地区|哪里|city|cities"),
    ("TOP_COMPANIES", r"公司|企业|雇主|compan"),
    ("TOP_INDUSTRIES", r"行业|industr"),
    ("EDUCATION", r"学历|本科|硕士|educat"),
    ("ROLE_TREND", r"趋势|逐年|历年|变化|增长|trend"),
    ("TECH_STACK", r"方向分布|技术方向|stack"),
    ("QUALITY_SUMMARY", r"数据质量|质量概况|quality"),
    ("JOB_SAMPLES", r"样例|例子|示例|原文|sample"),
    ("EVOLUTION_EVENTS", r"新增.{0,8}能力|能力演化|能力变化"),
    ("EMERGING_CANDIDATES", r"新岗位|新职位|萌芽|新兴岗位|候选岗位"),
    ("MARKET_SUMMARY", r"一共|总共|总量"),
    ("TOP_ROLES", r"岗位|职位|最多|排行|top|role|job"),
)
INTENTS = (
    ("LEARNING", r"学习|怎么学|路线|课程|learn"), ("MATCH", r"匹配|适合我|简历|match"), ("EMERGING", r"新岗位|新兴|萌芽|emerg"),
    ("EVOLUTION", r"演化|演变|能力变化|evolv|evolution"), ("GRAPH", r"图谱|关系|graph"), ("DATA", r"."),
)
_WORDS = re.compile(r"[一-鿿A-Za-z+#]{2,20}?(?:工程师|架构师|经理|顾问|分析师|研究员|专员)|\b[A-Za-z]+ (?:engineer|manager|analyst|consultant|researcher)\b", re.I)


def year_in(question: str) -> int | None:
    m = re.search(r"(?<!\d)(20\d{2})(?!\d)", question)
    if m:
        return int(m.group(1))
    m = re.search(r"(?<!\d)(\d{2})\s*(?:级|年|届)", question)
    return 2000 + int(m.group(1)) if m else None


def limit_in(question: str) -> int:
    m = re.search(r"(?:前|top\s*)(\d{1,3})", question, re.I)
    return max(1, min(MAX_LIMIT, int(m.group(1)))) if m else MAX_LIMIT


def role_in(question: str) -> str | None:
    m = _WORDS.search(re.sub(r"\d+年?|哪些|什么|需要|的|请问|根据", " ", question))
    return m.group(0).strip() if m else None


def intent_of(question: str) -> str:
    return next(name for name, pattern in INTENTS if re.search(pattern, question or "?", re.I | re.S))


def plans_for(question: str, most: int = 3) -> list[QueryPlan]:
    """Up to ``most`` different plans, the first rule's first; a question that fits none asks for a summary."""
    year, limit, role = year_in(question), limit_in(question), role_in(question)
    plans = []
    for kind, pattern in RULES:
        if re.search(pattern, question, re.I):
            span = kind == "ROLE_TREND"
            plans.append(QueryPlan(kind, None if span else year, year - 5 if span and year else None, year if span else None, role, None, limit))
    return plans[:most] or [QueryPlan("MARKET_SUMMARY", year=year)]
