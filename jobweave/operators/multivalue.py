"""Several values packed in one field -> one row per value, by minimum description length.

A *dialect* is a set of separators together with a rule for quotes. Every distinct field is
parsed under each dialect its characters allow. A parse costs, in bits,

* the code of the dialect (its separators and whether quotes are obeyed),
* the code of each value: ``-log2`` of its share in the value codebook, mixed with a
  character code for values the codebook hardly knows,
* an escape for each separator or quote that would have to stand bare inside a value,
* one separator choice between neighbouring pieces.

The codebook is counted over all fields in a distributed aggregation (a field divides its
weight evenly among its parses), so nothing about the values is gathered on the driver.
The cheapest parse of each distinct field is then applied to every row that holds it.
"""

from __future__ import annotations

import itertools
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.sources.scratch import cut

# Separators; every subset of those in a field is a dialect.
SEPARATORS = ("|", "｜", ",", "，", ";", "；", "、", "/", "／", "\t", "\n", "\r")
# Opening and closing quotes.
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "「": "」", "『": "』", "＂": "＂"}
BRACKETS = {"[": "]", "【": "】", "{": "}", "(": ")", "（": "）", "<": ">", "《": "》"}
_ANY_QUOTE = frozenset(QUOTES) | frozenset(QUOTES.values())

BITS_ESCAPE = 24.0  # a bare separator or quote inside a value
BITS_CHAR = 7.0  # a character of a value the codebook does not know
BITS_LENGTH = 8.0  # the length of such a value
BITS_SEPARATOR = 3.0  # naming one separator of a dialect

PARSES = "array<struct<dialect string, bits double, pieces array<string>>>"


def _unwrap(field: str) -> str:
    """``field`` without outer blanks and one pair of square, curly or lenticular brackets around all of it."""
    field = field.strip()
    while len(field) >= 2 and field[0] in "[【{" and BRACKETS[field[0]] == field[-1]:
        field = field[1:-1].strip()
    return field


def split_field(field: str, separators: frozenset[str], quoted: bool) -> tuple[list[str], int] | None:
    """Values of ``field`` under a dialect and the number of separators or quotes standing bare in
    values; None when quotes are obeyed but not closed."""
    pieces: list[str] = []
    bare, k, n = 0, 0, len(field)
    while k <= n:
        start = k
        while k < n and field[k] not in separators and field[k].isspace():
            k += 1
        if quoted and k < n and field[k] in QUOTES:
            close, k, got = QUOTES[field[k]], k + 1, []
            while True:
                if k >= n:
                    return None
                if field[k] == close:
                    if close in "\"'＂" and field[k + 1 : k + 2] == close:
                        got.append(close)
                        k += 2
                        continue
                    break
                got.append(field[k])
                k += 1
            k += 1
            rest = k
            while k < n and field[k] not in separators:
                k += 1
            if field[rest:k].strip():
                return None
            value = "".join(got).strip()
        else:
            while k < n and field[k] not in separators:
                k += 1
            value = field[start:k].strip()
            bare += sum(c in SEPARATORS or c in _ANY_QUOTE and c not in "'’" for c in value) + (value[:1] in ("'", "‘"))
            if len(value) >= 2 and BRACKETS.get(value[0]) == value[-1] and value[0] not in value[1:]:
                value = value[1:-1].strip()
        if value:
            pieces.append(value)
        k += 1
    return pieces, bare


def parses_of(field: str) -> list[tuple[str, float, list[str]]]:
    """Every different parse of ``field``: dialect, bits without those of its values, values."""
    body = _unwrap(field)
    present = [s for s in SEPARATORS if s in body]
    sets = [c for n in range(len(present) + 1) for c in itertools.combinations(present, n)]
    modes = (True, False) if any(c in _ANY_QUOTE for c in body) else (False,)
    best: dict[tuple[str, ...], tuple[str, float, list[str]]] = {}
    for chosen in sets:
        for quoted in modes:
            got = split_field(body, frozenset(chosen), quoted)
            if got is None:
                continue
            pieces, bare = got
            bits = BITS_SEPARATOR * len(chosen) + len(modes) - 1 + BITS_ESCAPE * bare + max(0, len(pieces) - 1) * math.log2(len(chosen) + 1)
            key = tuple(pieces)
            if key not in best or bits < best[key][1]:
                best[key] = ("".join(chosen) + ('"' if quoted else ""), bits, pieces)
    return list(best.values())


def _parses(fields: pd.Series) -> pd.Series:
    return pd.Series([[{"dialect": d, "bits": b, "pieces": p} for d, b, p in parses_of(f)] for f in fields])


def cheapest_parses(fields: DataFrame, field_col: str = "field", weight_col: str = "n") -> DataFrame:
    """(``field_col``, dialect, bits, pieces): of each distinct field its cheapest parse.

    ``fields`` has one row per distinct non-null field and how often it occurs. Ties go to
    the smaller number of values, then the smaller dialect name.
    """
    # Parsed once: the codebook, the costs and the choice all read the same parses. Fields are few bytes but
    # much work, so they are dealt out by number, which adaptive execution does not merge into one task.
    spark = fields.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parsed = cut(fields.repartition(tasks).select(field_col, weight_col, F.pandas_udf(_parses, PARSES)(field_col).alias("p")))
    single = F.size("p") == 1
    # A field with one parse needs no codebook, but feeds it.
    each = parsed.select(field_col, F.posexplode("p").alias("k", "parse"), (F.col(weight_col) / F.size("p")).alias("share"), (~single).alias("open"))
    values = each.select(field_col, "k", "share", "open", "parse.bits", F.explode("parse.pieces").alias("value"))
    codebook = values.groupBy("value").agg(F.sum("share").alias("uses"))
    total = codebook.agg(F.sum("uses").alias("all"))
    spelled = F.pow(F.lit(2.0), -F.least(F.lit(BITS_LENGTH) + BITS_CHAR * F.length("value"), F.lit(900.0)))
    coded = (
        values.where("open")
        .select(field_col, "k", "value")
        .join(codebook, "value")
        .crossJoin(F.broadcast(total))  # one row
        .groupBy(field_col, "k")
        .agg(F.sum(-F.log2((F.col("uses") + spelled) / (F.col("all") + 1))).alias("value_bits"))
    )
    ranked = F.struct((F.col("parse.bits") + F.coalesce("value_bits", F.lit(0.0))).alias("bits"), F.size("parse.pieces").alias("values"), "parse.dialect", "parse.pieces")
    chosen = each.where("open").join(coded, [field_col, "k"], "left").groupBy(field_col).agg(F.min(ranked).alias("b"))
    plain = parsed.where(single).select(field_col, F.col("p")[0]["dialect"].alias("dialect"), F.col("p")[0]["bits"].alias("bits"), F.col("p")[0]["pieces"].alias("pieces"))
    return chosen.select(field_col, "b.dialect", "b.bits", "b.pieces").unionByName(plain)


def split_values(df: DataFrame, id_col: str, field_col: str, table_name: str | None = None) -> DataFrame:
    """(table_name, row_id, item_pos, item_value): one row per value of ``field_col``, positions from 1.

    Null and blank fields give no row; a single value is a row as well. Repeated values keep
    their places, empty pieces take none. Repeated rows of ``df`` give repeated rows; a null
    id stays null. Fields without any separator, quote or bracket are their own single value
    and are parsed in the JVM. Other columns of ``df`` play no part.
    """
    rows = df.select(F.col(id_col).alias("row_id"), F.col(field_col).alias("field")).where(F.regexp_replace("field", r"[\s\u00a0\u2000-\u200a\u3000]+", "") != "")
    marks = "".join(sorted({*SEPARATORS, *_ANY_QUOTE, *BRACKETS, *BRACKETS.values()}))
    packed = F.length(F.translate("field", marks, "")) < F.length("field")
    trimmed = F.regexp_replace("field", r"^[\s\u00a0\u2000-\u200a\u3000]+|[\s\u00a0\u2000-\u200a\u3000]+$", "")
    fields = rows.groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    chosen = cheapest_parses(fields)
    pieces = rows.where(packed).join(chosen.select("field", "pieces"), "field").select("row_id", F.posexplode("pieces").alias("k", "item_value"))
    alone = rows.where(~packed).select("row_id", F.lit(0).alias("k"), trimmed.alias("item_value"))
    both = pieces.unionByName(alone)
    return both.select(F.lit(table_name or field_col).alias("table_name"), "row_id", (F.col("k") + 1).cast("long").alias("item_pos"), "item_value")
