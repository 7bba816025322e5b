"""Mixed timestamp notations and zones -> one UTC instant.

An ordered cascade of anchored patterns rewrites a notation into ten fixed fields
(year, month, day, hour, minute, second, half of the day, zone, first, second number of
an all-numeric date). The first pattern that matches wins; everything after it is strict:
a field out of range gives no instant. All of it runs inside the JVM.

Policy
* a stated offset or zone abbreviation is used as stated; of abbreviations with several
  meanings, BST is British summer time, IST Indian standard time, and CST follows the region
  of the source;
* without one, the home zone of the source (``zone_col``) applies;
* a local time that occurs twice is the earlier instant, one that never occurs is moved
  forward by the length of the gap (java.time's rule);
* a missing time of day is local midnight, missing seconds are zero, fractions are cut;
* ``year_col`` is only used when the text has no year, and only between ``min_year`` and
  ``max_year``.
* ten or thirteen digits alone are seconds or milliseconds since 1970;
* null, blank, wordy and impossible values give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Offsets in minutes of zone abbreviations with one meaning.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60,
    "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "SGT": 480, "HKT": 480, "JST": 540, "KST": 540,
    "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
# CST is the one abbreviation that depends on where the source sits.
CST_BY_REGION = {"Asia": 480, "America": -360}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d{1,9})?)?\s*([AaPp]\.?[Mm]\.?)?"
_ZONE = r"\s*((?:[A-Za-z]{1,5})?(?:[+-]\d{1,2}(?::?\d{2})?)?)(?:\[[A-Za-z_]+(?:/[A-Za-z_+\-]+)*\])?"
_TAIL = rf"(?:(?:[Tt]|,?\s+(?:at\s+)?){_TIME}{_ZONE})?"
_ZH_TIME = r"(?:\s*(凌晨|清晨|早上|早晨|上午|中午|下午|傍晚|晚上|夜里|深夜)?\s*(\d{1,2})[点时:](?:(\d{1,2})分?)?(?:(\d{1,2})秒)?)?"

# (anchored pattern, replacement with the fields y|mo|d|h|mi|s|half|zone|n1|n2)
CASCADE = (
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TAIL}$", "$1|$2|$3|$4|$5|$6|$7|$8||"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt ]?(\d{{2}}):?(\d{{2}})(?::?(\d{{2}}))?()()?{_ZONE})?$", "$1|$2|$3|$4|$5|$6||$9||"),
    (rf"^(\d{{4}})年\s*(\d{{1,2}})月\s*(\d{{1,2}})[日号]?{_ZH_TIME}$", "$1|$2|$3|$5|$6|$7|$4|||"),
    (rf"^(\d{{1,2}})月\s*(\d{{1,2}})[日号]?{_ZH_TIME}$", "|$1|$2|$4|$5|$6|$3|||"),
    (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})(?:st|nd|rd|th)?[-\s]([A-Za-z]{{3,9}})\.?[-,\s]+(\d{{4}}){_TAIL}$", "$3|$2|$1|$4|$5|$6|$7|$8||"),
    (rf"^(?:[A-Za-z]{{3,9}},\s+)?([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_TAIL}$", "$3|$1|$2|$4|$5|$6|$7|$8||"),
    (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){_TAIL}$", "$3|||$4|$5|$6|$7|$8|$1|$2"),
    (rf"^(\d{{1,2}})[-/.](\d{{1,2}}){_TAIL}$", "|||$3|$4|$5|$6|$7|$1|$2"),
)

# Seconds (10 digits) or milliseconds (13 digits) since 1970.
EPOCH = r"^[0-9]{10}(?:[0-9]{3})?$"

# English month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_FULL_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def plain(text: Column) -> Column:
    """Full-width digits, letters and signs to ASCII, unusual spaces to one blank, outer blanks off."""
    wide = "".join(chr(0xFF01 + k) for k in range(94))
    narrow = "".join(chr(0x21 + k) for k in range(94))
    text = F.translate(text, wide, narrow)
    text = F.regexp_replace(text, r"[\u200b-\u200d\u2060\ufeff\u00ad]", "")
    return F.trim(F.regexp_replace(text, r"[\s\u00a0\u2000-\u200a\u202f\u3000]+", " "))


def _int(field: Column) -> Column:
    return field.try_cast("int")


def _month(field: Column) -> Column:
    """Number of a month given in digits or as an English name or its first three letters (or 'sept')."""
    low = F.lower(field)
    by_name = F.create_map(*[F.lit(x) for k, m in enumerate(MONTHS) for x in (m, k + 1)])
    named = low.isin(*MONTHS, *_FULL_MONTHS, "sept")
    return F.when(named, F.try_element_at(by_name, F.substring(low, 1, 3))).otherwise(_int(field))


def _hour(hour: Column, half: Column) -> Column:
    """Hour 0..23 from an hour and a word for the half of the day; null when they contradict."""
    mark = F.regexp_replace(F.lower(half), r"\.", "")
    twelve = hour.between(1, 12)
    return (
        F.when(mark == "", hour)
        .when(mark == "am", F.when(twelve, hour % 12))
        .when(mark == "pm", F.when(twelve, hour % 12 + 12))
        .when(mark.isin("凌晨", "清晨", "早上", "早晨", "上午"), F.when(hour == 12, F.when(mark == "上午", 12).otherwise(0)).otherwise(hour))
        .when(mark == "中午", F.when(hour.between(1, 3), hour + 12).otherwise(hour))
        .when(mark.isin("下午", "傍晚"), F.when(hour < 12, hour + 12).otherwise(hour))
        .when(hour == 12, F.lit(0))
        .when(hour.between(5, 11), hour + 12)
        .otherwise(hour)
    )


def _offset(zone: Column, home: Column) -> Column:
    """Minutes east of UTC that ``zone`` states; null when it states nothing known."""
    name = F.upper(F.regexp_extract(zone, r"^([A-Za-z]*)", 1))
    digits = F.regexp_extract(zone, r"([+-]\d{1,2}(?::?\d{2})?)$", 1)
    hours = _int(F.regexp_extract(digits, r"^[+-](\d{1,2})", 1))
    minutes = F.coalesce(_int(F.regexp_extract(digits, r"^[+-]\d{1,2}:?(\d{2})$", 1)), F.lit(0))
    stated = F.when((hours <= 18) & (minutes < 60), (hours * 60 + minutes) * F.when(digits.startswith("-"), -1).otherwise(1))
    known = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v)])
    cst = F.create_map(*[F.lit(x) for k, v in CST_BY_REGION.items() for x in (k, v)])
    named = F.when(name == "CST", F.try_element_at(cst, F.substring_index(home, "/", 1))).otherwise(F.try_element_at(known, name))
    return F.when(digits != "", F.when(name.isin("", "GMT", "UTC", "UT", "Z"), stated)).otherwise(named)


def _with_instant(df: DataFrame, text_col: str, year_col: str, out_col: str, min_year: int, max_year: int) -> DataFrame:
    """``df`` (with ``__home``) and ``out_col``. The results of each step come from a one-row
    explode, which neither projections nor filters move across, so that nothing is computed twice."""
    s = F.col("__s")
    rewritten = F.lit(None).cast("string")
    for pattern, fields in reversed(CASCADE):
        rewritten = F.when(s.rlike(pattern), F.regexp_replace(s, pattern, fields)).otherwise(rewritten)
    f = [F.col("__f").getItem(k) for k in range(10)]
    home, order = F.col("__home.zone_name"), F.col("__home.date_order")
    first, second = _int(f[8]), _int(f[9])
    usable = F.when(df[year_col].between(min_year, max_year), df[year_col].cast("int"))
    month_first = order.isin("MDY", "YMD")
    steps = (
        {"__s": plain(df[text_col])},
        {"__f": F.split(rewritten, r"\|")},
        {
            "__y": F.when(f[0] == "", usable).otherwise(_int(f[0])),
            "__mo": F.when(f[8] == "", _month(f[1])).when(order == "DMY", second).when(month_first, first),
            "__d": F.when(f[8] == "", _int(f[2])).when(order == "DMY", first).when(month_first, second),
            "__h": F.when(f[3] == "", F.lit(0)).otherwise(_hour(_int(f[3]), f[6])),
            "__mi": F.when(f[4] == "", F.lit(0)).otherwise(_int(f[4])),
            "__se": F.when(f[5] == "", F.lit(0)).otherwise(_int(f[5])),
            "__off": F.when(f[7] != "", _offset(f[7], home)),
            "__bare": f[7] == "",
        },
        {"__local": F.expr("if(__h between 0 and 23 and __mi between 0 and 59 and __se between 0 and 59 and __y between 1 and 9999, try_make_timestamp_ntz(__y, __mo, __d, __h, __mi, cast(__se as decimal(16,6))), null)")},
        {out_col: F.when(s.rlike(EPOCH), F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(substring(__s, 1, 10) as decimal(18,6)))")).when(F.col("__bare"), F.when(home.isNotNull(), F.convert_timezone(home, F.lit("UTC"), F.col("__local")))).otherwise(F.expr("__local - make_dt_interval(0, 0, __off, 0)"))},
    )
    for step in steps:
        once = F.explode(F.array(F.struct(*[c.alias(name) for name, c in step.items()])))
        df = df.select("*", once.alias("__step")).select("*", "__step.*").drop("__step")
    return df.drop("__s", "__f", "__y", "__mo", "__d", "__h", "__mi", "__se", "__off", "__bare", "__local")


def normalise_timestamps(
    df: DataFrame,
    feeds: DataFrame,
    text_col: str = "posting_date",
    year_col: str = "posting_year",
    feed_col: str = "source_dataset",
    out_col: str = "instant_utc",
    feed_limit: int = 100_000,
    min_year: int = 1990,
    max_year: int = 2100,
) -> DataFrame:
    """``df`` with ``out_col``, the UTC instant of ``text_col`` or null.

    ``feeds`` (``feed_col``, zone_name, date_order) is the lookup of home zones; a feed
    listed twice counts with its smallest zone name, an unlisted or null feed has no home
    zone, so that only texts with a stated zone are readable. The lookup is broadcast when
    it has at most ``feed_limit`` rows and joined by a shuffle otherwise.

    Defined for nulls in every column, empty and very long texts (no pattern matches them),
    repeated rows (kept) and empty tables. Other columns of ``df`` stay as they are, also
    when they are named like those of the lookup.
    """
    home = feeds.where(F.col(feed_col).isNotNull()).groupBy(F.col(feed_col).alias("__feed")).agg(F.min(F.struct("zone_name", "date_order")).alias("__home"))
    small = home.select("__feed").limit(feed_limit + 1).count() <= feed_limit
    joined = df.join(F.broadcast(home) if small else home, df[feed_col] == F.col("__feed"), "left")
    return _with_instant(joined, text_col, year_col, out_col, min_year, max_year).drop("__feed", "__home")


def iso_utc(instant: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` of a timestamp without zone, independent of the session zone."""
    return F.concat(F.translate(F.substring(instant.cast("string"), 1, 19), " ", "T"), F.lit("Z"))
