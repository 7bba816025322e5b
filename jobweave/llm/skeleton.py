"""Visually identical text with different characters: skeletons over a look-alike table.

The skeleton of a text is its decomposition with every character replaced by a prototype,
decomposed again; texts that look the same have equal skeletons. The plain form undoes only
what stands in for a plain character, so that ordinary Chinese punctuation, accented letters
and Greek symbols stay readable.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.sources.scratch import spread

# Letters of other scripts and the Latin letter each looks like.
LOOK_ALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеорсухіѕјһԁԛԝҮү"
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρικχ"
        "ԱՕՍօոսԼ"
        "ɑɡıℓ",
        "ABESIJKMHOPCTYXaeopcyxisjhdqwYy"
        "ABEZHIKMNOPTYXovpikx"
        "UOUonuL"
        "agil",
        strict=False,
    )
)
# More such letters; they count beside Latin letters only, as words of their own scripts consist of them.
MORE_ALIKES = dict(
    zip(
        "вкмтнгпигьӀӏԌԍѵѴғҡқңһӕӔ"
        "αεβγητυωσιπςϲϳ"
        "աцհոգզղյքԲԳԵԻՏՀ"
        "ᎪᏴᏟᎠᎬᎡᏀᎻᎥᎫᏦᏞᎷᏢᎡᏚᎢᏙᏔᏃᎩᏒ"
        "ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲌⲁⲟⲣⲥⲭ",
        "bkmthrnurbllGgvVfkknhæÆ"
        "aebyntuwoinscj"
        "wuhngqnjpFSEhSH"
        "ABCDERGHiJKLMPRSTVWZYR"
        "ABEHIKMNOPCTYXZaopcx",
        strict=True,
    )
)
# Radical signs without a decomposition of their own and the Han character each stands for.
RADICALS = dict(
    zip(
        "⺁⺈⺊⺌⺍⺕⺜⺝⺠⺧⺩⺬⺮⺶⺸⺼⺾⻁⻄⻅⻆⻉⻋⻌⻏⻐⻒⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻨⻩⻬⻮⻰⻳",
        "厂刀卜小小彐冃月民牛王示竹羊羊肉艹虎西见角贝车辶阝金长长门青韦页风飞食马骨鬼鱼鸟麦黄齐齿龙龟",
        strict=True,
    )
)
# Beyond the prototypes of single characters, only a skeleton folds these together.
FOLDED = {"0": "O", "1": "l", "I": "l", "|": "l", "“": '"', "”": '"', "‘": "'", "’": "'", "—": "-", "–": "-", "・": "·", "•": "·"}

_OTHER_SCRIPT = "".join(c for c in LOOK_ALIKES if ord(c) > 0x36F)
_MORE = "".join(MORE_ALIKES)
_CYRILLIC = "".join(c for c in LOOK_ALIKES if 0x400 <= ord(c) < 0x530)
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb\U000e0000-\U000e0fff\\x00-\\x08\\x0e-\\x1f\\x7f-\\x84\\x86-\\x9f"
SPACES = "\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\\x0b\\x0c"
MARKS = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"
LIGATURES = "\u0132\u0133\u01c4-\u01cc\u01f1-\u01f3\ufb00-\ufb06"
WIDE = "\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff02-\uff07\uff0a\uff0b\uff0d-\uff0f\uff1c-\uff1e\uff20\uff3c\uff3e-\uff40"
STYLED = "\U0001d400-\U0001d7ff\u2102\u210a-\u2115\u2119-\u211d\u2124\u2128\u212c\u212d\u212f-\u2134\u24b6-\u24e9\U0001f130-\U0001f189"
RADICAL = "\u2e80-\u2fd5"
# One character of these is enough.
ALWAYS = f"[{INVISIBLE}{SPACES}{MARKS}{LIGATURES}{WIDE}{STYLED}{RADICAL}]"
# A letter of another script counts beside a Latin letter or a digit, or in a word of look-alikes only.
BESIDE = f"[{_OTHER_SCRIPT}](?=[A-Za-z0-9])|(?<=[A-Za-z0-9])[{_OTHER_SCRIPT}]"
ALONE = f"(?<![\\u0400-\\u052f])[{_CYRILLIC}]+(?![\\u0400-\\u052f])"
# Any other letter of these scripts counts beside a Latin letter; the micro sign is of no script.
# Scripts that are written beside Latin words as a matter of course (Han, kana, Hangul, bopomofo) are not among them.
FOREIGN = (
    "\u03e2-\u03ef\u0400-\u0481\u048a-\u052f\u1c80-\u1c8a\ua640-\ua66e\ua680-\ua69b"  # Coptic in the Greek block, Cyrillic
    "\u0531-\u0556\u0560-\u0588\u13a0-\u13f5\u13f8-\u13fd\uab70-\uabbf\u2c80-\u2ce4\u2ceb-\u2cee"  # Armenian, Cherokee, Coptic
    "\u05d0-\u05f2\u0620-\u063f\u0641-\u064a\u066e\u066f\u0671-\u06d3\u0e01-\u0e30\u10a0-\u10fa\u10fd-\u10ff"  # Hebrew, Arabic, Thai, Georgian
    "\u1401-\u166c\u166f-\u167f\u16a0-\u16ea\ua4d0-\ua4f7\ua500-\ua60b"  # Canadian syllabics, runes, Lisu, Vai
    "\U00010280-\U0001029c\U000102a0-\U000102d0\U00010300-\U0001031f\U00010400-\U0001049d\U000104b0-\U000104fb\U000118a0-\U000118df\U00016f00-\U00016f4a"  # Lycian, Carian, Old Italic, Deseret, Osage, Warang Citi, Miao
    "\u0299\u0262\u026a\u0274\u0280\u028f\u029c\u029f\u1d00\u1d03-\u1d05\u1d07\u1d0a-\u1d0f\u1d18\u1d1b-\u1d1c\u1d20-\u1d22\ua730\ua731"  # small capitals of Latin
)
# Greek letters are also symbols and units (kΩ, μmol, ΔT, TNFα), so they count inside words and at the end of lower-case ones.
GREEK = "\u0370-\u0373\u0376\u0377\u037b-\u037d\u037f\u0386\u0388-\u03a8\u03aa-\u03bb\u03bd-\u03e1\u03f0-\u03f5\u03f7-\u03ff\u1f00-\u1fbc\u1fc2-\u1fcc\u1fd0-\u1fdb\u1fe0-\u1fec\u1ff2-\u1ffc"
UNIT = "\u03a9\u03bc\u2126"
INSIDE = (
    f"[{FOREIGN}](?=[A-Za-z])|(?<=[A-Za-z])[{FOREIGN}]"
    f"|(?<=[A-Za-z])[{GREEK}](?=[A-Za-z])|(?<![A-Za-z])[{GREEK}](?=[a-z]{{3}})|(?<=[a-z]{{3}})[{GREEK}](?![A-Za-z])"
    f"|(?<=[A-Za-z]{{2}})[{UNIT}](?=[A-Za-z])"
)
_STAND_IN = re.compile(f"{ALWAYS}|{BESIDE}|(?P<alone>{ALONE})|{INSIDE}")
_LETTER = re.compile(f"{BESIDE}|(?P<alone>{ALONE})|{INSIDE}")
_CYRILLIC_WORD = re.compile("(?<![A-Za-z\u0400-\u052f])[\u0400-\u052f]+(?![A-Za-z\u0400-\u052f])")
_SCRIPT = re.compile(f"[{FOREIGN}{GREEK}{UNIT}]")
_SINGLE = re.compile(ALWAYS)
_REMOVED = re.compile(f"[{INVISIBLE}]")
_SPACE = re.compile(f"[{SPACES}]")
_WORD = re.compile(f"[A-Za-z0-9{FOREIGN}{GREEK}{UNIT}{_OTHER_SCRIPT}{_MORE}]+")
_MAYBE = f"[^\\x09\\x0a\\x0d\\x20-\\x7e\\u4e00-\\u9fff\\u3001-\\u301f\\uff01\\uff08\\uff09\\uff0c\\uff1a\\uff1b\\uff1f]"


_confusable: dict[str, str] = {}


def confusables(spark: SparkSession) -> dict[str, str]:
    """Letters of other scripts and the Latin letter each looks like, beyond the tables above.

    They are asked of the Unicode confusables data in the ICU library that comes with Spark,
    those of small capitals of their names. The size is bounded by Unicode. Without ICU there is
    an error, as results by a shorter table could not be told from whole ones. Executors get the
    table with the functions that use it.
    """
    letters = [c for c in map(chr, range(0x80, 0x20000)) if _SCRIPT.match(c) and unicodedata.category(c)[0] == "L"]
    found = {c: n[-1].lower() for c in letters if re.fullmatch("LATIN LETTER SMALL CAPITAL [A-Z]", n := unicodedata.name(c, ""))}
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except TypeError as e:  # a name without a class behind it is not callable
        raise RuntimeError("Look-alike letters need the ICU library that comes with Spark 4: no com.ibm.icu.text.SpoofChecker on the driver's class path") from e
    looks = checker.getSkeleton("\n".join(letters)).split("\n")
    return found | {c: p for c, p in zip(letters, looks, strict=True) if c not in found and len(p) == 1 and p.isascii() and p.isalpha()}


def use_confusables(table: dict[str, str]) -> None:
    """Let the functions of this process know ``table``."""
    global _confusable
    if table != _confusable:
        _confusable = table
        prototype.cache_clear()
        _odd.cache_clear()


@lru_cache(maxsize=65536)
def prototype(char: str) -> str:
    """The plain character(s) that ``char`` looks like, or itself."""
    if _REMOVED.match(char):
        return ""
    if _SPACE.match(char):
        return "\n" if char in "\u2028\u2029\u0085" else " "
    for table in (RADICALS, LOOK_ALIKES, MORE_ALIKES, _confusable):
        if char in table:
            return table[char]
    if _SINGLE.match(char) and not unicodedata.combining(char):
        return unicodedata.normalize("NFKC", char)
    return char


def plain_form(text: str) -> str:
    """``text`` with every stand-in replaced by what it stands for and accents composed.

    A text without stand-ins is its own plain form, whole words of other scripts stay as they
    are. In a word with a stand-in all letters of other scripts are replaced where each of
    them has a prototype, otherwise only those that stand beside Latin letters.
    """
    if not stand_ins(text):
        return text
    text = _SINGLE.sub(lambda m: m.group(0) if unicodedata.combining(m.group(0)) else prototype(m.group(0)), text)
    spots = set(_places(_LETTER, text))

    def plain(m: re.Match) -> str:
        word, at = m.group(0), m.start()
        if spots.isdisjoint(range(at, m.end())):
            return word
        every = all(c < "\x80" or prototype(c) != c for c in word)
        return "".join(prototype(c) if c > "\x7f" and (every or at + k in spots) else c for k, c in enumerate(word))

    return unicodedata.normalize("NFC", _WORD.sub(plain, text) if spots else text)


def skeleton(text: str) -> str:
    """Decompose, put the prototype for every character, decompose again."""
    text = unicodedata.normalize("NFD", text)
    if not text.isascii():
        text = "".join(map(prototype, text))
        text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text))
    return "".join(FOLDED.get(c, c) for c in text)


@lru_cache(maxsize=65536)
def _odd(char: str) -> bool:
    """Whether the skeleton has something else in place of ``char``, or ``char`` is a separate accent,
    or a radical or a letter of another script without a prototype in the table."""
    return prototype(char) != char or bool(_SINGLE.match(char) or _SCRIPT.match(char))


def stand_ins(text: str) -> list[int]:
    """Places of the characters that stand in for a plain one or cannot be seen.

    Each character is compared with its prototype in the skeleton; those that differ are
    checked for what stands beside them, as a letter of another script may be meant as such.
    """
    odd = {c for c in set(text) if c > "\x7e" or c < " " if _odd(c)}
    if not odd:
        return []
    return [k for k in _places(_STAND_IN, text) if text[k] in odd]


def _places(pattern: re.Pattern, text: str) -> list[int]:
    """Places that ``pattern`` matches; a Cyrillic word of look-alikes is a word like others where the text has other Cyrillic words."""
    found = list(pattern.finditer(text))
    if any(m.lastgroup for m in found) and any(c not in _CYRILLIC for word in _CYRILLIC_WORD.findall(text) for c in word):
        found = [m for m in found if not m.lastgroup]
    return [k for m in found for k in range(m.start(), m.end())]


PLAIN = "struct<plain string, stand_ins int>"
SKELETON = "struct<plain string, skeleton string>"


def _forms(table: dict[str, str]):
    def run(texts: pd.Series) -> pd.DataFrame:
        use_confusables(table)
        rows = [(None, None) if t is None else (plain_form(t), len(stand_ins(t))) for t in texts]
        return pd.DataFrame(rows, columns=["plain", "stand_ins"]).astype({"stand_ins": "Int32"})

    return F.pandas_udf(run, PLAIN)


def _skeletons(table: dict[str, str]):
    def run(texts: pd.Series) -> pd.DataFrame:
        use_confusables(table)
        return pd.DataFrame([(None, None) if t is None else (plain_form(t), skeleton(t)) for t in texts], columns=["plain", "skeleton"])

    return F.pandas_udf(run, SKELETON)


def _counts(table: dict[str, str]):
    def run(texts: pd.Series) -> pd.Series:
        use_confusables(table)
        return pd.Series([None if t is None else len(stand_ins(t)) for t in texts], dtype="Int32")

    return F.pandas_udf(run, "int")


def may_differ(text: Column) -> Column:
    """False only where a text is made of plain ASCII, Han characters and common Chinese punctuation."""
    return text.rlike(_MAYBE)


def _tall(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id_col, field_name, text): one row per row of ``df`` and field."""
    return df.select(F.col(id_col), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("x")).select(id_col, "x.*")


def looking_alike(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id_col, field_name, stand_ins): texts of ``df`` with characters whose prototypes in the skeleton
    differ from them and that stand in for others or cannot be seen.

    In texts left out by :func:`may_differ` every character is its own prototype. Null and
    empty texts give no row; repeated rows give repeated rows; other columns play no part.
    """
    texts = spread(_tall(df, id_col, fields).where(may_differ(F.col("text"))))
    return texts.select(id_col, "field_name", _counts(confusables(df.sparkSession))("text").alias("stand_ins")).where("stand_ins > 0")


def with_forms(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id_col, field_name, text, plain, stand_ins), one row per row of ``df`` and field.

    ``stand_ins`` counts the characters that stand in for others or cannot be seen; a null
    text has null forms, an empty one empty forms. Texts of plain characters only are their
    own plain form; nulls go to Python in their place, so that one scan serves both. Repeated
    rows stay; other columns play no part.
    """
    tall = spread(_tall(df, id_col, fields))
    formed = tall.withColumn("f", _forms(confusables(df.sparkSession))(F.when(may_differ(F.col("text")), F.col("text"))))
    return formed.select(id_col, "field_name", "text", F.coalesce("f.plain", "text").alias("plain"), F.coalesce("f.stand_ins", F.when(F.col("text").isNotNull(), 0)).alias("stand_ins"))


def equal_looking(df: DataFrame, field: str) -> DataFrame:
    """(skeleton, plain, spellings, rows): values of ``field`` grouped by equal skeleton.

    ``spellings`` counts the different originals that look alike, ``plain`` is the most
    frequent plain form (smallest among equals). Values are deduplicated before they reach
    Python and grouped with partial aggregation; nulls form no group.
    """
    values = df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    formed = values.withColumn("f", _skeletons(confusables(df.sparkSession))("text")).select("text", "n", "f.plain", "f.skeleton")
    per_plain = formed.groupBy("skeleton", "plain").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("spellings"))
    return per_plain.groupBy("skeleton").agg(
        F.min(F.struct((-F.col("n")).alias("o"), "plain"))["plain"].alias("plain"),
        F.sum("spellings").alias("spellings"),
        F.sum("n").alias("rows"),
    )
