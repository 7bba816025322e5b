"""Free-entered values mapped to the closest entry of a reference list.

Values are deduplicated, brought to a plain form and cut into character n-grams: single
characters and pairs of Chinese runs, triples of Latin words with their ends marked. An
inverted index over the reference list retrieves every entry that shares a weighted n-gram;
the score is the cosine of the n-gram vectors weighted by rarity in the list, where n-grams
that the list does not know weigh nothing. So what surrounds an entry (seniority, place,
perks) does not lower its score, and misspelt characters cost only the n-grams they touch.
The best entry is accepted above a threshold and with a margin before the next one.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobweave.llm.skeleton import plain_form
from jobweave.sources.scratch import cut

_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])")
_RUNS = re.compile(r"[a-z0-9+#]+|[一-鿿]")
_HAN = re.compile(r"[一-鿿]")


def normal_value(value: str) -> str:
    """Plain form, lower case, words that ran together at a capital split, runs of blanks single."""
    plain = _CAMEL.sub(" ", plain_form(value))
    return " ".join(plain.lower().split())


def grams(normal: str) -> list[str]:
    """Different n-grams of a normal value, in order. Separators within Chinese runs do not break pairs."""
    tokens = _RUNS.findall(normal)
    out: list[str] = []
    for k, t in enumerate(tokens):
        if _HAN.match(t):
            out.append(t)
            if k + 1 < len(tokens) and _HAN.match(tokens[k + 1]):
                out.append(t + tokens[k + 1])
        else:
            marked = f"^{t}$"
            out += [marked[j : j + 3] for j in range(max(1, len(marked) - 2))]
    return list(dict.fromkeys(out))


def _normal(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else normal_value(v) for v in values], dtype=object)


def _grams(values: pd.Series) -> pd.Series:
    return pd.Series([[] if v is None else grams(v) for v in values])


def inverted_index(reference: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """(gram, weight2, entry, entry_norm): squared weight of each n-gram and the norm of each entry that has it."""
    each = reference.where(F.col(name_col).isNotNull()).select(F.col(id_col).alias("entry"), F.pandas_udf(_normal, "string")(name_col).alias("v"))
    posted = each.groupBy("entry").agg(F.min("v").alias("v")).select("entry", F.explode(F.pandas_udf(_grams, "array<string>")("v")).alias("gram"))
    size = posted.agg(F.countDistinct("entry").alias("n"))
    rarity = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(size)).select("gram", F.pow(rarity, F.lit(2.0)).alias("weight2"))  # one row
    index = posted.join(weighted, "gram")
    norms = index.groupBy("entry").agg(F.sqrt(F.sum("weight2")).alias("entry_norm"))
    return index.join(norms, "entry")


def match_values(
    values: DataFrame,
    value_col: str,
    reference: DataFrame,
    id_col: str,
    name_col: str,
    threshold: float = 0.62,
    margin: float = 0.03,
    reference_limit: int = 20_000,
) -> DataFrame:
    """(value_col, rows, entry, score, runner_up): each different non-blank value and its entry, or null.

    ``entry`` is null when the best score is below ``threshold`` or not ``margin`` before the
    score of the next entry; ``score`` and ``runner_up`` are kept for the report of unmatched
    values. Null and blank values are left out, equal values counted in ``rows``. Equal scores
    go to the smaller id, and are no margin. The index is broadcast up to ``reference_limit``
    entries and joined by a shuffle beyond. An empty reference list matches nothing.
    """
    distinct = values.where(F.trim(value_col) != "").groupBy(F.col(value_col).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    normal = cut(distinct.withColumn("normal", F.pandas_udf(_normal, "string")("value")).where("normal <> ''"))
    forms = normal.select("normal").distinct().withColumn("g", F.pandas_udf(_grams, "array<string>")("normal"))
    index = cut(inverted_index(reference, id_col, name_col))
    small = reference.select(id_col).limit(reference_limit + 1).count() <= reference_limit
    index = F.broadcast(index) if small else index
    known = F.broadcast(index.select("gram", "weight2").distinct()) if small else index.select("gram", "weight2").distinct()
    # One shuffle by value: the sums, the norms and the ranking below all keep its partitioning.
    pieces = cut(forms.select("normal", F.explode("g").alias("gram")).join(known, "gram")).repartition("normal")
    norms = pieces.groupBy("normal").agg(F.sqrt(F.sum("weight2")).alias("norm"))
    dots = pieces.drop("weight2").join(index, "gram").groupBy("normal", "entry").agg(F.sum("weight2").alias("dot"), F.first("entry_norm").alias("entry_norm"))
    scored = dots.join(norms, "normal").select("normal", "entry", F.round(F.col("dot") / (F.col("norm") * F.col("entry_norm")), 9).alias("score"))
    order = Window.partitionBy("normal").orderBy(F.desc("score"), F.asc("entry"))
    first_two = scored.withColumn("place", F.row_number().over(order)).where("place <= 2")
    pick = lambda place, column: F.max(F.when(F.col("place") == place, F.col(column)))
    found = first_two.groupBy("normal").agg(pick(1, "entry").alias("best"), pick(1, "score").alias("score"), F.coalesce(pick(2, "score"), F.lit(0.0)).alias("runner_up"))
    accepted = (F.col("score") >= threshold) & (F.col("score") - F.col("runner_up") >= margin)
    named = normal.join(found, "normal", "left")
    return named.select(F.col("value").alias(value_col), "rows", F.when(accepted, F.col("best")).alias("entry"), "score", "runner_up", F.col("best").alias("nearest"))
