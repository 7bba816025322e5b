"""Profiles out of resume texts: sections, name, contact, education, experience, projects, skills, years.

Parsing is line by line with state, which column expressions cannot hold; texts go to Python
in Arrow batches and come back as one struct of records.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Section headings, degrees, labels.
HEADINGS = {
    "head": ("基本信息", "个人信息", "个人资料", "联系方式", "basicinfo", "personalinfo", "contact"),
    "education": ("教育背景", "教育经历", "学历背景", "教育信息", "学习经历", "education", "educationalbackground", "academicbackground"),
    "experience": ("工作经历", "工作经验", "任职经历", "职业经历", "全职经历", "experience", "workexperience", "employment", "professionalexperience"),
    "internship": ("实习经历", "实习经验", "实践经历", "社会实践", "internship", "internships", "internshipexperience"),
    "projects": ("项目经历", "项目经验", "项目实践", "主要项目", "科研经历", "竞赛经历", "课程设计", "projects", "projectexperience", "portfolio"),
    "skills": ("专业技能", "技能清单", "技能特长", "个人技能", "技术栈", "技能", "skills", "technicalskills", "techstack"),
    "honours": ("证书荣誉", "证书与荣誉", "获奖经历", "荣誉奖项", "certificates", "certifications", "honors", "awards"),
    "summary": ("自我评价", "个人简介", "个人总结", "个人评价", "个人概述", "summary", "profile", "selfevaluation", "objective"),
}
NO_NAMES = frozenset(h for names in HEADINGS.values() for h in names) | {"姓名", "简历", "个人简历", "候选人", "求职意向"}
DEGREES = (("博士", "博士|ph\\.?d|doctor"), ("硕士", "硕士|研究生|master|m\\.?sc|mba"), ("本科", "本科|学士|bachelor|b\\.?sc"), ("大专", "大专|专科|diploma|associate"))
NAME_LABEL = re.compile(r"^(?:姓\s*名|name)\s*[:：]?\s*([一-鿿·][一-鿿· ]{1,7}|[A-Za-z][A-Za-z .'-]{1,40})(?:[|｜,，;；]|$)", re.I)
LATIN_NAME = re.compile(r"[A-Z][a-z]{1,19}(?:[ .'-][A-Z][a-z]{1,19}){1,3}")
SCHOOL = re.compile(r"[一-鿿A-Za-z ]{2,40}?(?:大学|学院|学校|university|college|institute)(?!生)", re.I)
MAJOR_LABEL = re.compile(r"(?:专业\s*[:：]\s*([一-鿿A-Za-z ]{2,30}))|([一-鿿]{2,15})专业")
MAJOR_WORD = re.compile(r"计算机|软件|信息|数据|智能|电子|通信|数学|统计|管理|工程|科学|技术|自动化|网络|science|engineering|statistics|mathematics|systems", re.I)
NOT_MAJOR = re.compile(r"主修|课程|绩点|gpa|排名|奖学金", re.I)
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH_WORD = r"(?:(?P<{0}>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*)?"
_POINT = r"(?P<{0}>(?:19|20)\d{{2}})(?:\s*[./年-]\s*(?P<{1}>\d{{1,2}})(?!\d)\s*月?|\s*年)?"
RANGE = re.compile(
    _MONTH_WORD.format("mw") + _POINT.format("y1", "m1") + r"\s*(?:-{1,2}|—{1,2}|–|~|～|至|到|to)\s*(?:" + _MONTH_WORD.format("nw") + _POINT.format("y2", "m2") + r"|(?P<open>至今|现在|今|present|now))", re.I
)
YEARS_MONTHS = re.compile(r"(\d{1,2})\s*年\s*(\d{1,2})\s*个?月(?:的)?(?:工作|开发|项目|实习|相关|行业)*经验")
YEARS = re.compile(r"(?<![\d.])(\d{1,2}(?:\.\d)?)\s*\+?\s*(?:年(?:以上)?(?:的)?(?:工作|开发|项目|实习|相关|行业|研发)*经验|years?\s+(?:of\s+)?(?:\w+\s+){0,2}experience)", re.I)
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PHONE = re.compile(r"(?<!\d)1[3-9]\d{9}(?!\d)")
COMPANY = re.compile(r"^(.{1,40}?(?:有限公司|公司|集团|研究中心|研究院|研究所|实验室|银行|证券|中心|事业部|科技(?!有限|公司|集团|股份)|Inc\.?|Ltd\.?|Corp\.?)(?:[（(][^）)]{1,8}[）)])?)\s*(.*)$")
ROLE = re.compile(r"实习生|工程师|分析师|研究员|助理|专员|顾问|经理|运营|intern\b|engineer|developer|analyst|assistant|manager", re.I)
PROJECT_NAME = re.compile(r"系统|平台|项目|引擎|应用|小程序|网站|工具|模型|app\b|system|platform|project|engine", re.I)
DETAIL = re.compile(r"^(?:技术栈|技术环境|技术|职责|描述|成果|负责|完成|参与|基于|使用|实现|设计|搭建|优化|建立|通过|responsib|built|implemented)", re.I)
STACK = re.compile(r"^(?:技术栈|技术环境)\s*[:：]\s*(.+)$")
NUMBERING = re.compile(r"^(?:\d{1,2}\s*[.、)）](?!\d)|[-•●*◆■]|项目(?:名称|[一二三四五六七八九十\d])?\s*[:：])\s*")
SOURCES = (("skills", 0.98), ("projects", 0.88), ("experience", 0.86), ("internship", 0.86), ("head", 0.78), ("summary", 0.78))
WEAK, KEPT, CORE = 0.68, 0.76, 0.84

RECORDS = {
    "education_records": "array<struct<school string, degree string, major string, period string>>",
    "experience_records": "array<struct<company string, role string, period string, intern boolean, description string>>",
    "project_records": "array<struct<name string, stack string, description string>>",
    "skill_records": "array<struct<skill string, score double, hits int>>",
}
PROFILE = (
    "struct<name string, has_contact boolean, degree string, school string, major string, months int, years double, skills array<string>, projects int, sections array<string>, rate double, "
    + ", ".join(f"{k} {v}" for k, v in RECORDS.items())
    + ">"
)


def normal_text(text: str) -> str:
    """Compatibility form, single blanks, trimmed lines, at most one empty line in a row."""
    lines = [re.sub(r"[ \t\u00a0]+", " ", line).strip() for line in unicodedata.normalize("NFKC", text).splitlines()]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def heading_of(line: str) -> str | None:
    bare = re.sub(r"[\s:：|｜/\-—–_#*=【】\[\]●■◆★•·]+", "", line).lower()
    return next((s for s, names in HEADINGS.items() if bare in names), None) if len(bare) <= 32 else None


def split_sections(text: str) -> dict[str, list[str]]:
    """Lines under each heading; those before any heading are under ``head``."""
    out: dict[str, list[str]] = {"head": []}
    now = "head"
    for line in text.split("\n"):
        heading = heading_of(line)
        if heading:
            now = heading
            out.setdefault(now, [])
        elif line:
            out[now].append(line)
    return out


def _month(m: re.Match, word: str, number: str, default: int) -> int:
    if m.group(word):
        return MONTHS.index(m.group(word).lower()) + 1
    return min(12, max(1, int(m.group(number)))) if m.group(number) else default


def months_of(lines: Iterable[str], as_of: tuple[int, int]) -> int:
    """Months covered by the date ranges of ``lines``; overlapping months count once, open ends reach ``as_of``."""
    covered: set[int] = set()
    for line in lines:
        for m in RANGE.finditer(line):
            begin = int(m.group("y1")) * 12 + _month(m, "mw", "m1", 1) - 1
            end = as_of[0] * 12 + as_of[1] - 1 if m.group("open") else int(m.group("y2")) * 12 + _month(m, "nw", "m2", 12) - 1
            covered.update(range(begin, min(end, begin + 12 * 60) + 1))
    return len(covered)


def _name(raw: str) -> str | None:
    han = re.sub(r"[\s·•]+", "", raw)
    if re.fullmatch(r"[一-鿿]{2,4}", han):
        return None if han in NO_NAMES or ROLE.search(han) else han
    latin = raw.strip()
    return latin if LATIN_NAME.fullmatch(latin) and latin.lower().replace(" ", "") not in NO_NAMES else None


def find_name(lines: list[str], file_name: str | None = None, first: int = 8) -> str | None:
    """By its label anywhere, else a line that is nothing but a name among the ``first`` ones, else in the file's name."""
    for line in lines:
        m = NAME_LABEL.match(line)
        if m:
            return re.sub(r"(?<=[一-鿿])\s+(?=[一-鿿])", "", m.group(1)).strip()
    for line in [x for x in lines if x][:first]:
        if heading_of(line) is None and (name := _name(line)):
            return name
    for part in reversed(re.split(r"[_—-]", re.sub(r"\.(?:pdf|docx?|txt)$", "", file_name or "", flags=re.I))):
        if name := _name(re.sub(r"(?i)resume|cv|简历|测试|样例|模板", "", part)):
            return name
    return None


def _degree(text: str) -> str | None:
    return next((d for d, p in DEGREES if re.search(p, text, re.I)), None)


def _period(text: str) -> str:
    m = RANGE.search(text)
    return m.group(0).strip() if m else ""


def _bare(line: str) -> str:
    """A line without its numbering and dates."""
    return re.sub(r"^[·•|｜,，;；\s-]+|[·•|｜,，;；\s-]+$", "", RANGE.sub(" ", NUMBERING.sub("", line))).strip()


def education_records(lines: list[str]) -> list[dict]:
    """A record for each school, or for each stretch of lines with a degree where no school is named."""
    blocks: list[list[str]] = []
    for line in lines:
        school = bool(SCHOOL.search(line))
        dated_first = blocks and not any(SCHOOL.search(x) for x in blocks[-1])
        if not blocks or school and not dated_first or _period(line) and any(_period(x) for x in blocks[-1]) and not dated_first:
            blocks.append([])
        blocks[-1].append(line)
    out = []
    for block in blocks:
        joined = " ".join(block)
        school, degree = SCHOOL.search(RANGE.sub(" ", joined)), _degree(joined)
        if not school and not degree:
            continue
        name = school.group(0).strip() if school else None
        label = MAJOR_LABEL.search(joined)
        major = (label.group(1) or label.group(2)).strip() if label else None
        for part in [] if major else re.split(r"[·•|｜\s,，]+", RANGE.sub(" ", joined)):
            rest = part.replace(name or "\0", "")
            for _, pattern in DEGREES:
                rest = re.sub(pattern, "", rest, flags=re.I)
            if 2 <= len(rest) <= 24 and MAJOR_WORD.search(rest) and not NOT_MAJOR.search(rest):
                major = rest
                break
        out.append({"school": name, "degree": degree, "major": major, "period": _period(joined)})
    return out


def _headed(line: str) -> bool:
    """Whether a line can name a company and a role."""
    bare = _bare(line)
    return 0 < len(bare) <= 60 and not bare.endswith(("。", "；", ".")) and not DETAIL.match(bare) and bool(COMPANY.match(bare) or ROLE.search(bare) or re.search(r"\S\s*[·•|｜]\s*\S", bare))


def experience_records(lines: list[str], internship: bool) -> list[dict]:
    """Records of company, role, period and what was done; one begins where the last has both a heading and dates and either comes again."""
    blocks: list[list[str]] = []
    for line in lines:
        full = blocks and any(_period(x) for x in blocks[-1]) and any(_headed(x) for x in blocks[-1])
        if not blocks or full and (_period(line) or _headed(line)):
            blocks.append([])
        blocks[-1].append(line)
    out = []
    for block in blocks:
        k = next((k for k, x in enumerate(block) if _headed(x)), None)
        if k is None or not (period := _period(" ".join(block))):
            continue
        heading = _bare(block[k])
        parts = [x for x in re.split(r"\s*[·•|｜]\s*", heading, maxsplit=1) if x]
        known = COMPANY.match(heading)
        company, role = parts if len(parts) == 2 else known.groups() if known else (heading.split(" ", 1) + [""])[:2]
        told = [x for j, x in enumerate(block) if j != k and _bare(x)]
        out.append({"company": company.strip(), "role": role.strip() or None, "period": period, "intern": internship or bool(re.search(r"实习|\bintern", role, re.I)), "description": " ".join(told)})
    return out


def project_records(lines: list[str]) -> list[dict]:
    """Records of name, technologies and what was done; names are numbered or name a system, details follow them."""
    out: list[dict] = []
    for line in lines:
        stack, bare = STACK.match(line), _bare(line)
        if not bare:
            continue
        name, _, tools = (x.strip() for x in bare.partition("|"))
        numbered = bool(NUMBERING.match(line)) and not out[-1:] or bool(re.match(r"^(?:\d{1,2}\s*[.、)）](?!\d)|项目)", line))
        titled = len(name) <= 60 and not name.endswith(("。", "；", ".")) and not DETAIL.match(name) and not SCHOOL.search(name) and (numbered or bool(PROJECT_NAME.search(name)))
        if stack and out:
            out[-1]["stack"] = stack.group(1).strip()
        elif titled:
            out.append({"name": name, "stack": tools or None, "description": ""})
        elif out:
            out[-1]["description"] = f"{out[-1]['description']} {bare}".strip()
    return out


def listed_skills(lines: list[str]) -> list[str]:
    """Items of the skills section, in order."""
    return list(dict.fromkeys(s.strip() for line in lines for s in re.split(r"[、,，;；/|]|\s{2,}", re.sub(r"^[^:：]{0,8}[:：]", "", line)) if 1 < len(s.strip()) <= 40))


def _hits(text: str, low: str, skill: str) -> int:
    """How often a text names a skill; words of Latin letters end where letters end."""
    if re.fullmatch(r"[A-Za-z0-9+#.]{1,3}", skill):
        return len(re.findall(rf"(?<![A-Za-z0-9]){re.escape(skill)}(?![A-Za-z0-9+#])", text, re.I))
    return low.count(skill.lower())


def skill_records(sections: dict[str, list[str]], text: str, known: Iterable[str] = ()) -> list[dict]:
    """Skills with the score of the strongest section that names them, surest first; ``known`` adds names to look for."""
    out = []
    places = [(score, "\n".join(sections.get(s, []))) for s, score in SOURCES]
    places = [(score, part, part.lower()) for score, part in places if part] + [(WEAK, text, text.lower())]
    for skill in dict.fromkeys([*listed_skills(sections.get("skills", [])), *known]):
        found = [(score, n) for score, part, low in places if (n := _hits(part, low, skill))]
        if found:
            out.append({"skill": skill, "score": max(s for s, _ in found), "hits": found[-1][1]})
    strong = [r for r in out if r["score"] >= KEPT or len(r["skill"]) > 3]
    return sorted(strong, key=lambda r: (-r["score"], -r["hits"], r["skill"]))


def parse_profile(text: str, as_of: tuple[int, int] = (2026, 6), file_name: str | None = None, known: Iterable[str] = ()) -> dict:
    text = normal_text(text)
    sections = split_sections(text)
    lines = text.split("\n")
    education = sections.get("education") or [x for x in lines if SCHOOL.search(x) and _degree(x)]
    studies = education_records(education)
    degree = next((s["degree"] for s in studies if s["degree"]), None) or _degree("\n".join(education) or text)
    work, interned = sections.get("experience", []), sections.get("internship", [])
    months = months_of([*work, *interned], as_of)
    stated = [int(y) + int(m) / 12 for y, m in YEARS_MONTHS.findall(text)] or [float(y) for y in YEARS.findall(text)]
    years = round(stated[0] if stated else months / 12, 2)
    jobs = experience_records(work, False) + experience_records(interned, True)
    projects = project_records(sections.get("projects", []))
    skills = skill_records(sections, text, known)
    name = find_name(lines, file_name)
    contact = bool(EMAIL.search(text) or PHONE.search(text))
    rate = 10 * (name is not None) + 30 * min(1, len(skills) / 6) + 22 * (months > 0 or years > 0) + 18 * min(1, len(projects)) + 16 * (degree is not None) + 4 * contact
    first = studies[0] if studies else {}
    listed = listed_skills(sections.get("skills", []))
    return {
        "name": name, "has_contact": contact, "degree": degree, "school": first.get("school"), "major": first.get("major"), "months": months, "years": years,
        "skills": [*listed, *(r["skill"] for r in skills if r["skill"] not in set(listed))], "projects": len(projects), "sections": sorted(s for s, v in sections.items() if v and s != "head"),
        "rate": round(float(rate), 2), "education_records": studies, "experience_records": jobs, "project_records": projects, "skill_records": skills,
    }


# What a resume holds, and how much each of them says.
SIGNS = (
    (2, "姓名|求职意向|个人简历|基本信息"), (2, "教育背景|教育经历|学历背景"), (2, "实习经历|工作经历|项目经历|项目经验|科研竞赛|校园经历"), (1, r"(?:19|20)[0-9]{2}[^0-9]{0,2}[0-9]{0,2}[^0-9]{0,3}(?:-|—|–|至|~|～)[^0-9]{0,3}(?:(?:19|20)[0-9]{2}|至今|现在)"),
    (1, r"1[3-9][0-9]{9}|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), (1, "(?i)java|python|sql|mysql|redis|spring|tensorflow|pytorch|tableau"),
)
RESUME_SCORE, RESUME_LENGTH = 4, 80


def resume_likeness(text: Column) -> Column:
    """Points for what a resume holds; a text below 80 characters has none. From 4 on it is taken for a resume."""
    score = sum((F.when(text.rlike(pattern), points).otherwise(0) for points, pattern in SIGNS), F.lit(0))
    return F.when(F.length(text) < RESUME_LENGTH, 0).otherwise(score)


def parse_profiles(df: DataFrame, id_col: str, text_col: str, as_of: tuple[int, int] = (2026, 6), file_col: str | None = None, known: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, profile fields and records) of every non-blank text; open date ranges end at ``as_of``.

    ``file_col`` names the file a text came from, for names that stand only there; ``known``
    are names of skills to look for beside those a resume lists. Repeated rows stay, null and
    blank texts give no row.
    """
    fields = list(parse_profile("x"))

    def run(texts: pd.Series, files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_profile(t, as_of, f, known) for t, f in zip(texts, files, strict=True)], columns=fields)

    file = F.col(file_col) if file_col else F.lit(None).cast("string")
    return df.where(F.trim(text_col) != "").select(F.col(id_col), F.pandas_udf(run, PROFILE)(text_col, file).alias("p")).select(id_col, "p.*")
