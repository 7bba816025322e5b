"""Personal information in free text: anchors by Aho-Corasick, expanded by local parsers.

One automaton finds at-signs, schemes, dialling prefixes, street words and cue words in a
length-tracked plain form of the text (look-alikes, wide and invisible characters undone).
At each anchor a small deterministic parser expands to the boundaries of an email address,
phone number, identity number, account, street address or name and validates them; what does not
validate is left alone. Spans refer to the original text, so all the rest stays untouched.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.skeleton import LOOK_ALIKES, prototype
from jobweave.sources.scratch import spread

KINDS = ("email", "phone", "id_number", "address", "person")
ALL_KINDS = (*KINDS, "account")
# Cue words. Those for numbers stand before the number.
EMAIL_ANCHORS = ("@", "(at)", "[at]", "{at}", "<at>", " at ", "#at#", "艾特")
PHONE_CUES = ("电话", "手机", "短信", "拨", "打", "致电", "来电", "热线", "座机", "联系方式", "call", "text", "tel", "phone", "mobile", "cell", "fax", "whatsapp", "sms")
SCHEMES = ("mailto:", "tel:", "sms:", "callto:")
PHONE_STARTS = ("+", "(", "13", "14", "15", "16", "17", "18", "19", "0086", "001", "400", "800", "一三", "一四", "一五", "一六", "一七", "一八", "一九", "幺")
PHONE_DASHES = ("-",)
ID_CUES = ("身份证", "证件", "公民号码", "ssn", "social", "holder id", "national id", "identity")
ID_YEARS = ("19", "20")
STREET_ANCHORS_ZH = ("号", "弄")
STREET_WORDS_EN = ("street", "road", "avenue", "drive", "lane", "way", "court", "square", "boulevard", "terrace", "crescent", "close", "parade", "rise", "row", "gardens", "grove", "hill", "walk", "mews", "place", "path", "circle", " st", " rd", " ave", " blvd", " dr", " ln")
NAME_CUES_ZH = ("联系人", "面试官", "主管是", "主管为", "找", "由", "导师是", "对接人", "负责人是", "经理是", "咨询")
NAME_TITLES_ZH = ("工程师", "经理", "主管", "总监", "老师", "顾问", "同事")
# The most frequent family names; only these are taken for names right behind a title.
FAMILY_NAMES = frozenset("王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤")
NAME_CUES_EN = ("my name is", "contact", "contact person", "report to", "reports to", "ask for", "reach out to", "speak to", "speak with", "interviewer", "mentor", "attn", "attention of", "hiring manager is", "recruiter is", "meet with")
# Parts of titles, teams and objects that follow such cues without being names.
NOT_NAMES_ZH = ("管理", "模块", "团队", "小组", "部", "组", "中心", "经理", "主管", "总监", "工程师", "公司", "前台", "人事", "客服", "专员", "老师", "面试", "电话", "邮箱", "方式", "系统", "平台", "信息", "列表", "字段", "分组", "接口", "岗位", "职位", "业务", "工作", "资料", "需求", "各", "我们", "您", "本", "该", "其", "助理", "院", "处", "科", "室", "站", "厂", "店")
NOT_NAMES_EN = frozenset(
    "the a an our your this that team lead manager director head department office desk hr human resources recruiter recruiting engineer engineering "
    "analyst consultant officer platform product data group company board staff support reception front security chief vice president supervisor "
    "coordinator administrator specialist assistant us them him her site project program service customer".split()
)
# What counted things are followed or preceded by.
COUNTED_AFTER = re.compile(r"\s?(?:条|行|次|个|项|件|笔|张|份|元|人|台|家|套|万|亿|rows?\b|records?\b|messages?\b|requests?\b|events?\b|items?\b|users?\b|bytes?\b|units?\b|lines?\b)", re.I)
COUNTED_BEFORE = re.compile(r"(?:流水号?|编号|单号|订单|序列号|代码|版本|批次|serial|part|ticket|build|order|invoice|ref|no\.?|id)[:#\s]*$", re.I)
# What a number and 号 name when they are no address.
NUMBERED = ("线", "仓", "井", "机", "位", "码", "员", "站", "炉", "泵", "车", "船", "令", "文件", "标准")
# Cue words of accounts; lengths of the account numbers of a country are not checked beyond their check digits.
ACCOUNT_CUES = ("银行卡", "卡号", "账号", "帐号", "开户", "信用卡", "储蓄卡", "card number", "account number", "account no", "iban")
IBAN_COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO SA SE SI SK TR UA".split()
IBAN_STARTS = tuple(f"{c.lower()}{d}" for c in IBAN_COUNTRIES for d in range(10))

_ODD = re.compile(r"[^\t\n\r -~一-鿿、。【】，：；（）！？《》“”‘’—…·]")
# One character for one character, so that places stay.
_SAME_LENGTH = str.maketrans({0xFF01 + k: 0x21 + k for k in range(94)} | {"【": "[", "】": "]", "〇": "零", "　": " "})


def plain_with_places(text: str) -> tuple[str, list[int] | None]:
    """Plain form of ``text`` and, unless they are the same, the original place of each character."""
    if not _ODD.search(text):
        return text.translate(_SAME_LENGTH), None
    plain, places = [], []
    for k, c in enumerate(text):
        for p in c if c < "\x80" else prototype(c):
            plain.append(LOOK_ALIKES.get(p, p))
            places.append(k)
    places.append(len(text))
    return "".join(plain).translate(_SAME_LENGTH), places


_LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?$|[A-Za-z0-9]$")
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|点)\s?[\])}>]\s?|\s+dot\s+|点)"
_DOMAIN = re.compile(rf"\s{{0,2}}((?:[A-Za-z0-9](?:[A-Za-z0-9-]{{0,62}}))(?:{_DOT}[A-Za-z0-9-]{{1,63}})*?{_DOT}[A-Za-z]{{2,24}})(?![A-Za-z0-9-])(?!{_DOT}[A-Za-z0-9])", re.I)


def _email(s: str, start: int, end: int) -> tuple[int, int] | None:
    left = s[max(0, start - 66) : start]
    trimmed = left.rstrip(" ")
    if len(left) - len(trimmed) > 2:
        return None
    local = _LOCAL.search(trimmed)
    domain = _DOMAIN.match(s, end)
    if not local or not domain:
        return None
    if s[start:end].strip().lower() == "at" and not re.search(r"\bdot\b", domain.group(1), re.I):
        return None
    return start - (len(left) - local.start()), domain.end(1)


_STOP = r"(?![0-9A-Za-z]|[-.][0-9A-Za-z])"
_NUMERAL = "零一二三四五六七八九幺"
_CUED_PHONE = re.compile(
    rf"(?:(?:\+|00)86[\s-]?)?1[3-9]\d([\s.-]?)\d{{4}}\1\d{{4}}{_STOP}"
    rf"|\(?0\d{{2,3}}\)?[\s-]?\d{{7,8}}(?:\s?(?:转|ext\.?|x)\s?\d{{1,6}})?{_STOP}"
    rf"|(?:(?:\+|00)1[\s.-]?)?(?:\(\d{{3}}\)\s?|\d{{3}}[\s.-]?)\d{{3}}[\s.-]?\d{{4}}{_STOP}"
    rf"|[48]00[\s-]?\d{{3,4}}[\s-]?\d{{3,4}}{_STOP}"
    rf"|\+\d{{1,3}}(?:[\s.-]?\(?\d{{2,4}}\)?){{2,4}}{_STOP}"
    rf"|[一幺](?:[\s-]?[{_NUMERAL}]){{10}}(?![{_NUMERAL}])"
)
_BARE_PHONE = re.compile(
    rf"(?:(?:\+|00)86[\s-]?)?1[3-9]\d([\s-]?)\d{{4}}\1\d{{4}}{_STOP}"
    rf"|\(0\d{{2,3}}\)\s?\d{{7,8}}(?:\s?(?:转|ext\.?|x)\s?\d{{1,6}})?{_STOP}"
    rf"|(?:\+|00)1[\s.-]?(?:\(\d{{3}}\)\s?|\d{{3}}[\s.-]?)\d{{3}}[\s.-]?\d{{4}}{_STOP}"
    rf"|\(\d{{3}}\)\s?\d{{3}}[-.\s]\d{{4}}{_STOP}"
    rf"|[48]00([\s-]?)(?:\d{{3}}\2\d{{4}}|\d{{4}}\2\d{{3}}){_STOP}"
    rf"|\+\d{{1,3}}(?:[\s.-]\(?\d{{2,4}}\)?){{2,4}}{_STOP}"
    rf"|[一幺][三四五六七八九](?:[\s-]?[{_NUMERAL}]){{9}}(?![{_NUMERAL}])"
)
# Without a sign at their start: a landline, and area code and number of North America.
_DASHED_PHONE = re.compile(
    rf"0\d{{2,3}}-\d{{7,8}}(?:\s?(?:转|ext\.?|x)\s?\d{{1,6}})?{_STOP}"
    rf"|[2-9]\d\d-[2-9]\d\d-\d{{4}}{_STOP}"
)
_AFTER_CUE = re.compile(r"(?:号码?|号|至|到|为|是|请|咨询|number|no\.?|us|me|at|on|or|\s|[:：.,;、，;/])*", re.I)


def _phone_after(s: str, start: int, end: int) -> tuple[int, int] | None:
    if s[start : start + 1].isascii() and s[start].isalpha() and start and s[start - 1].isalpha() and s[start - 1].isascii():
        return None
    at = _AFTER_CUE.match(s, end).end()
    m = _CUED_PHONE.match(s, at)
    return (m.start(), m.end()) if m and not COUNTED_AFTER.match(s, m.end()) else None


def _phone_at(s: str, start: int, end: int, form: re.Pattern = _BARE_PHONE) -> tuple[int, int] | None:
    before = s[start - 1] if start else " "
    if before.isascii() and (before.isalnum() or before in "-._/@#") or before in _NUMERAL:
        return None
    m = form.match(s, start)
    if not m or COUNTED_AFTER.match(s, m.end()) or COUNTED_BEFORE.search(s[max(0, start - 12) : start]):
        return None
    return m.start(), m.end()


def _phone_dash(s: str, start: int, end: int) -> tuple[int, int] | None:
    for back in (3, 4):
        span = _phone_at(s, start - back, end, _DASHED_PHONE) if start >= back else None
        if span:
            return span
    return None


_MONTHDAY = r"(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])"
_ID18 = re.compile(rf"(?<![0-9A-Za-z])(?<![0-9A-Za-z]-)[1-9]\d{{5}}([\s-]?)(?:19|20)\d\d{_MONTHDAY}\1\d{{3}}[0-9Xx](?![0-9A-Za-z]|-[0-9A-Za-z])")
_ID15 = re.compile(rf"[1-9]\d{{5}}([\s-]?)\d\d{_MONTHDAY}\1\d{{3}}(?![0-9A-Za-z]|-[0-9A-Za-z])")
_SSN = re.compile(r"\d{3}([-\s.]?)\d{2}\1\d{4}(?![0-9A-Za-z]|-[0-9A-Za-z])")
_AFTER_ID = re.compile(r"(?:号码?|号|为|是|number|security|no\.?|card|\s|[:：.,#])*", re.I)


def _id_after(s: str, start: int, end: int) -> tuple[int, int] | None:
    at = _AFTER_ID.match(s, end).end()
    for form in (_ID18, _ID15, _SSN):
        m = form.match(s, at)
        if m:
            return m.start(), m.end()
    return None


def _id_at(s: str, start: int, end: int) -> tuple[int, int] | None:
    for back in (6, 7):
        m = _ID18.match(s, start - back) if start >= back else None
        if m:
            return m.start(), m.end()
    return None


_STREET_ZH = re.compile(r"(?:[一-鿿]{1,8}?[省市区县镇乡])*[一-鿿]{1,8}(?:路|街|大道|巷|胡同|道|里|弄|段)(?:[东南西北中]段)?\s?\d{1,5}(?:[-之]\d{1,4})?(?:弄\s?\d{1,5})?[号弄]$")
_STREET_LEAD = re.compile(r"^.*(?:地址|地点|集合|面试|报到|资料|简历|请|寄往|寄至|位于|前往|[在到至往于])(?:是|为)?")
_ROOM_ZH = re.compile(r"(?:\s?[一-鿿]{0,8}?(?:\d{1,4}|[A-Za-z])\s?(?:号楼|栋|幢|座|层|楼|室|单元|号))+")


def _street_zh(s: str, start: int, end: int) -> tuple[int, int] | None:
    if not start or not (s[start - 1].isdigit() and s[start - 1].isascii()) or s.startswith(NUMBERED, end):
        return None
    base = max(0, start - 34)
    m = _STREET_ZH.search(s[base:end])
    if not m:
        return None
    text = m.group(0)
    lead = _STREET_LEAD.match(text)
    begin = base + m.start() + (lead.end() if lead and _STREET_ZH.match(text, lead.end()) else 0)
    room = _ROOM_ZH.match(s, end)
    return begin, room.end() if room else end


STREET_LOWER = ("street", "road", "avenue", "lane", "boulevard")  # of these a small letter is no other word behind a number and a name
_NUMBER_EN = re.compile(r"(?<![\w-])\d{1,5}[A-Za-z]?\s+(?:[A-Z][\w'’-]*\s+){1,4}$")
_UNIT_EN = re.compile(r"(?:,?\s+(?:Apt|Apartment|Unit|Suite|Ste|Floor|Flat|#)\.?\s*\w{1,5})?(?:,\s+[A-Z][a-z]+(?:\s[A-Z][a-z]+)?)?", re.I)


def _street_en(s: str, start: int, end: int) -> tuple[int, int] | None:
    word = s[start:end].lstrip()
    begin = end - len(word)
    if not word[:1].isupper() and word not in STREET_LOWER or s[end : end + 1].isalnum() or re.match(r"\.?\s+(?!Apt|Unit|Suite|Floor|Flat|Ste\b)[A-Z]\w+\s+\w", s[end : end + 40]) and not re.match(r"\.\s", s[end : end + 2]):
        return None
    base = max(0, begin - 60)
    m = _NUMBER_EN.search(s[base:begin])
    if not m:
        return None
    unit = _UNIT_EN.match(s, end)
    return base + m.start(), unit.end()


_NAME_ZH = re.compile(r"(?:\s|[:：是为])*([一-鿿]{2,4}?)(?=$|[^一-鿿]|会|登记|报到|老师|先生|女士|安排|带领|带教|面试|对接|负责|联系|咨询)")


def _name_zh(s: str, start: int, end: int) -> tuple[int, int] | None:
    m = _NAME_ZH.match(s, end)
    if not m:
        return None
    cue, name = s[start:end], m.group(1)
    if any(x in name for x in NOT_NAMES_ZH):
        return None
    if cue == "找" and (not s[:start].endswith(("请", "后", "来", "去", "直接")) or s.startswith("会", m.end(1))):
        return None
    if cue in ("由", "咨询") and not s.startswith(("老师", "先生", "女士"), m.end(1)):
        return None
    if cue == "联系人" and s[end : end + 1] not in (":", "是", "为", " "):
        return None
    return m.start(1), m.end(1)


_WORD = r"[A-Z][A-Za-z'’]*(?:-[A-Z][A-Za-z'’]*)*"
_NAME_EN = re.compile(rf"(?:\s*(?::|is\b))?\s*(?:(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+)?((?:[A-Z]\.\s?)+{_WORD}|{_WORD},\s{_WORD}|{_WORD}(?:\s(?:[A-Z]\.\s)?{_WORD}){{1,2}})(?![a-z])")


def _name_en(s: str, start: int, end: int) -> tuple[int, int] | None:
    if start and s[start - 1].isalpha() or s[end : end + 1].isalpha():
        return None
    m = _NAME_EN.match(s, end)
    if not m:
        return None
    words = re.findall(r"[A-Za-z]+", m.group(1))
    if any(w.lower() in NOT_NAMES_EN for w in words):
        return None
    return m.start(1), m.end(1)


_NAME_AFTER_TITLE = re.compile(r"([一-鿿]{2,3}?)(?=负责|对接|联系|带领|带教|安排|跟进|会与|会在|老师|先生|女士)")


def _name_after_title(s: str, start: int, end: int) -> tuple[int, int] | None:
    m = _NAME_AFTER_TITLE.match(s, end)
    if not m or m.group(1)[0] not in FAMILY_NAMES or any(x in m.group(1) for x in NOT_NAMES_ZH):
        return None
    return m.span(1)


_AFTER_ACCOUNT = re.compile(r"(?:号码?|号|为|是|number|no\.?|\s|[:：.,#])*", re.I)
_CARD = re.compile(r"\d{4}(?:[\s-]?\d{4}){2,3}(?:[\s-]?\d{1,4})?(?![0-9A-Za-z])")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")


def iban_valid(text: str) -> bool:
    """Check digits of an international account number: the number modulo 97 is one."""
    bare = re.sub(r"\s", "", text).upper()
    return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def card_valid(text: str) -> bool:
    """Check digit of a card number: digits, every second one from the right doubled, add up to tens."""
    digits = [int(c) for c in reversed(text) if c.isdigit()]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0


def id_valid(text: str) -> bool:
    """Check digit of an identity number of 18 places: weights of powers of two modulo 11."""
    bare = re.sub(r"[\s-]", "", text).upper()
    return len(bare) == 18 and "10X98765432"[sum(int(c) * pow(2, 17 - k, 11) for k, c in enumerate(bare[:17])) % 11] == bare[17]


def _iban_at(s: str, start: int, end: int) -> tuple[int, int] | None:
    if start and s[start - 1].isalnum() and s[start - 1].isascii():
        return None
    m = _IBAN.match(s, start)
    return m.span() if m and iban_valid(m.group(0)) else None


def _account_after(s: str, start: int, end: int) -> tuple[int, int] | None:
    """A card number behind a cue; the cue stands in for a check digit that does not fit."""
    at = _AFTER_ACCOUNT.match(s, end).end()
    m = _CARD.match(s, at)
    return m.span() if m else _iban_at(s, at, at)


def _scheme(s: str, start: int, end: int) -> tuple[int, int] | None:
    """The number behind a scheme such as tel:; addresses behind mailto: are found at their at-sign."""
    m = _CUED_PHONE.match(s, end)
    return m.span() if m else None


Parser = Callable[[str, int, int], tuple[int, int] | None]
PARSERS: tuple[tuple[str, Parser, tuple[str, ...]], ...] = (
    ("email", _email, EMAIL_ANCHORS),
    ("account", _account_after, ACCOUNT_CUES),
    ("account", _iban_at, IBAN_STARTS),
    ("id_number", _id_after, ID_CUES),
    ("id_number", _id_at, ID_YEARS),
    ("phone", _scheme, SCHEMES),
    ("phone", _phone_after, PHONE_CUES),
    ("phone", _phone_at, PHONE_STARTS),
    ("phone", _phone_dash, PHONE_DASHES),
    ("address", _street_zh, STREET_ANCHORS_ZH),
    ("address", _street_en, STREET_WORDS_EN),
    ("person", _name_zh, NAME_CUES_ZH),
    ("person", _name_after_title, NAME_TITLES_ZH),
    ("person", _name_en, NAME_CUES_EN),
)


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found: dict[str, list[int]] = {}
    for k, (_, _, anchors) in enumerate(PARSERS):
        for a in anchors:
            found.setdefault(a, []).append(k)
    automaton = ahocorasick.Automaton()
    for a, parsers in found.items():
        automaton.add_word(a, (len(a), tuple(parsers)))
    automaton.make_automaton()
    return automaton


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal data in ``text``, in order, not overlapping; an identity
    number goes before a phone number where both would fit."""
    s, places = plain_with_places(text)
    low = s.lower()
    if len(low) != len(s):  # a few letters change length; their case plays no part
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
    got: list[tuple[int, int, int]] = []
    reached = [0] * len(PARSERS)
    for last, (length, parsers) in _automaton().iter(low):
        start, end = last + 1 - length, last + 1
        for k in parsers:
            if start < reached[k]:
                continue
            span = PARSERS[k][1](s, start, end)
            if span:
                got.append((k, *span))
                reached[k] = span[1]
    got.sort()
    taken: list[tuple[int, int, str]] = []
    for k, start, end in got:
        if all(end <= a or start >= b for a, b, _ in taken):
            taken.append((start, end, PARSERS[k][0]))
    if places is not None:
        taken = [(places[a], places[b - 1] + 1, kind) for a, b, kind in taken]
    return sorted(taken)


def redact(text: str) -> str:
    """``text`` with every span replaced by its kind in square brackets."""
    out, at = [], 0
    for start, end, kind in find_spans(text):
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def _kinds(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else sorted({k for _, _, k in find_spans(t)}) for t in texts])  # of ALL_KINDS


def _redacted(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else redact(t) for t in texts], dtype=object)


def personal_data_kinds(df: DataFrame, id_col: str, text_col: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(id_col, pii_kind): each of ``kinds`` of personal data of which a row's text holds at least one.

    Whole texts are read. Null and empty texts give no row; repeated rows give repeated rows;
    a null id stays null. Other columns play no part.
    """
    found = spread(df.where(F.length(text_col) > 0).select(id_col, text_col)).select(F.col(id_col), F.pandas_udf(_kinds, "array<string>")(text_col).alias("k"))
    return found.select(id_col, F.explode("k").alias("pii_kind")).where(F.col("pii_kind").isin(*kinds))


def redacted(df: DataFrame, text_col: str, out_col: str = "redacted") -> DataFrame:
    """``df`` with ``out_col``: the text with typed placeholders, everything else as it was; null stays null."""
    return spread(df).withColumn(out_col, F.pandas_udf(_redacted, "string")(text_col))
