"""Year-over-year forecast of rising roles and its rolling backtest; discovery of new roles.

All windows are in one plan keyed by the training year. Titles are aggregated twice: distinct
evidence per title as written, then sums per normal title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions.measures import analysable, clamp, distinct_filled, double, evidence, first_half, momentum, saturation
from jobweave.functions.text import bigrams, forecast_title, title_similarity
from jobweave.operators.market import titled

SIMILAR = 0.72


def title_years(jobs: DataFrame, low: int = 2000, high: int = 2100, normal: Column | None = None) -> DataFrame:
    """(year, title, n, companies, sources, h1, h2, quality, shown): per year and normal title.

    ``shown`` is the most frequent spelling, the greatest among equals.
    """
    rows = jobs.where(analysable() & titled() & F.col("published_year").between(low, high))
    written = rows.groupBy("published_year", "title_standard").agg(
        evidence().alias("n"), evidence(first_half()).alias("h1"), evidence(F.month("published_at") > 6).alias("h2"),
        distinct_filled("company").alias("companies"), distinct_filled("source_name").alias("sources"), F.avg(double("quality_score")).alias("q"),
    )
    named = written.withColumn("title", forecast_title(F.col("title_standard")) if normal is None else normal).where(F.length("title") >= 2)
    return named.groupBy(F.col("published_year").alias("year"), "title").agg(
        F.sum("n").alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2"), F.sum("companies").alias("companies"), F.sum("sources").alias("sources"),
        (F.sum(F.col("q") * F.col("n")) / F.sum("n")).alias("quality"), F.max(F.struct("n", "title_standard"))["title_standard"].alias("shown"),
    )


def candidates(years: DataFrame, min_support: int = 3, top: int = 50) -> DataFrame:
    """Ranked candidates of every training year: new against the year before, gaining within the year, well supported."""
    w = Window.partitionBy("title").orderBy("year")
    previous = F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag("n").over(w))
    rows = years.withColumn("previous", F.coalesce(previous, F.lit(0))).where(F.col("n") >= min_support)
    c = F.col
    novelty = F.when(c("previous") == 0, F.lit(1.0)).otherwise(clamp(1 - F.least(F.lit(1.0), c("previous") / F.greatest(F.lit(1), c("n")))))
    rows = rows.withColumns({
        "novelty": novelty, "momentum": momentum(c("h1"), c("h2")), "support": saturation(c("n"), 60),
        "diversity": clamp(c("companies") / F.greatest(F.lit(3), F.least(c("n"), F.lit(15)))),
    })
    balance = F.when(c("h1") + c("h2") == 0, F.lit(0.0)).otherwise(clamp(1 - F.abs(c("h1") - c("h2")) / (c("h1") + c("h2"))))
    rows = rows.withColumns({
        "score": clamp(0.34 * c("novelty") + 0.28 * c("momentum") + 0.20 * c("support") + 0.18 * c("diversity")),
        "confidence": clamp(0.38 * c("support") + 0.34 * c("diversity") + 0.18 * balance + 0.10 * F.when(c("n") >= 5, 1.0).otherwise(0.6)),
    })
    rising = (c("novelty") >= 0.40) | ((c("novelty") >= 0.15) & (c("momentum") >= 0.60))
    order = Window.partitionBy("year").orderBy(F.desc(F.round("score", 9)), F.desc("n"), F.asc("title"))
    return rows.where((c("score") >= 0.52) & rising).withColumn("place", F.row_number().over(order)).where(c("place") <= top)


def emerged(years: DataFrame, min_support: int = 3) -> DataFrame:
    """(year, title): titles that really rose in the year after ``year``."""
    before = years.select((F.col("year") + 1).alias("year"), "title", F.col("n").alias("was"))
    observed = years.select((F.col("year") + 1).alias("year")).distinct()  # a year counts only when the one before was observed
    joined = years.join(observed, "year", "left_semi").join(before, ["year", "title"], "left").withColumn("was", F.coalesce("was", F.lit(0)))
    grown = (F.col("n") >= min_support) & ((F.col("was") == 0) | (F.col("n") >= F.greatest(F.lit(float(min_support)), F.col("was") * 1.25)))
    return joined.where(grown).select((F.col("year") - 1).alias("year"), "title")


def best_matches(chosen: DataFrame, years: DataFrame) -> DataFrame:
    """Each candidate with the most similar title of the next year.

    Titles that share no pair of characters have similarity 0 and equal, contained or one-character-longer
    ones share at least one, so joining on shared pairs loses no match above 0.
    """
    grams = lambda c: F.explode(bigrams(F.replace(c, F.lit(" "), F.lit(""))))
    left = chosen.select("year", F.col("title").alias("predicted"), grams(F.col("title")).alias("gram"))
    right = years.select((F.col("year") - 1).alias("year"), F.col("title").alias("actual"), F.col("n").alias("actual_count"), grams(F.col("title")).alias("gram"))
    pairs = left.join(right, ["year", "gram"]).select("year", "predicted", "actual", "actual_count").distinct()
    scored = pairs.withColumn("similarity", F.round(title_similarity(F.col("predicted"), F.col("actual")), 9))
    best = scored.groupBy("year", "predicted").agg(F.max(F.struct("similarity", "actual_count", "actual")).alias("m"))
    return best.select("year", "predicted", "m.similarity", "m.actual_count", "m.actual")


def backtest_rows(years: DataFrame, min_support: int = 3, top: int = 50) -> DataFrame:
    """Candidates of every year that has a next one, with their match and whether they hit."""
    chosen = candidates(years, min_support, top)
    next_years = years.select((F.col("year") - 1).alias("year")).distinct()
    joined = chosen.join(next_years, "year", "left_semi").join(best_matches(chosen, years).withColumnRenamed("predicted", "title"), ["year", "title"], "left")
    grown = F.col("actual_count") >= F.greatest(F.lit(float(min_support)), F.col("n") * 1.25)
    hit = F.coalesce((F.col("similarity") >= SIMILAR) & grown, F.lit(False))
    return joined.select("year", "place", "title", "n", "previous", "novelty", "momentum", "score", "confidence", "actual", "actual_count", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), hit.alias("hit"))


def backtest(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall, F1, similarity, calibration and trust of every window."""
    matched = rows.where("hit").select("year", F.col("actual").alias("title")).distinct().join(truth, ["year", "title"], "left_semi").groupBy("year").agg(F.count(F.lit(1)).alias("found"))
    real = truth.groupBy("year").agg(F.count(F.lit(1)).alias("emerged"))
    per = rows.groupBy("year").agg(
        F.count(F.lit(1)).alias("predicted"), F.count_if("hit").alias("hits"), F.sum(F.when(F.col("hit"), F.col("similarity")).otherwise(0.0)).alias("sim"),
        F.sum(F.pow(F.col("score") - F.col("hit").cast("int"), F.lit(2.0))).alias("brier"), F.avg("confidence").alias("sure"),
    ).join(real, "year", "left").join(matched, "year", "left")
    c = F.col
    per = per.withColumns({"precision": c("hits") / c("predicted"), "recall": F.coalesce(F.coalesce("found", F.lit(0)) / c("emerged"), F.lit(0.0)), "calibration": clamp(1 - c("brier") / c("predicted")), "similarity": F.when(c("hits") > 0, c("sim") / c("hits")).otherwise(0.0)})
    per = per.withColumn("f1", F.when(c("precision") + c("recall") == 0, 0.0).otherwise(2 * c("precision") * c("recall") / (c("precision") + c("recall"))))
    trust = clamp(0.42 * c("precision") + 0.20 * c("calibration") + 0.18 * c("similarity") + 0.20 * c("sure"))
    r = lambda x: F.round(x, 4)
    return per.select("year", "predicted", "hits", F.coalesce("emerged", F.lit(0)).alias("emerged"), r(c("precision")).alias("precision"), r(c("recall")).alias("recall"), r(c("f1")).alias("f1"), r(c("similarity")).alias("similarity"), r(c("calibration")).alias("calibration"), r(trust).alias("trust"))


def novelty(t: Column, s: Column, g: Column, sources: Column, samples: Column) -> Column:
    return 0.3 * t + 0.25 * s + 0.25 * g + 0.1 * F.least(F.lit(1.0), sources / 4) + 0.1 * F.least(F.lit(1.0), samples / 12)


def trust_confidence(evidence_: Column, sources: Column, fresh: Column, duplicate: Column, semantic: Column) -> Column:
    return clamp(0.25 * F.least(F.lit(1.0), evidence_ / 8) + 0.25 * F.least(F.lit(1.0), sources / 4) + 0.20 * fresh + 0.20 * semantic + 0.10 * (1 - duplicate))


def trust_risk(evidence_: Column, sources: Column, confidence: Column, generated: Column) -> Column:
    return clamp(0.55 * (1 - confidence) + F.when(sources < 2, 0.2).otherwise(0.0) + F.when(evidence_ < 3, 0.15).otherwise(0.0) + F.when(generated, 0.25).otherwise(0.0))


def discovered(years: DataFrame, top: int = 30) -> DataFrame:
    """New or accelerating roles of every training year, ranked."""
    c = F.col
    dated = c("h1") + c("h2")
    late = F.when(dated == 0, 0.5).otherwise(c("h2") / F.greatest(F.lit(1), dated))
    growth = F.when(c("h1") == 0, F.when(c("h2") > 0, 1.0).otherwise(0.5)).otherwise(clamp(0.5 + 0.5 * (c("h2") - c("h1")) / F.greatest(F.lit(1), dated)))
    fresh = (c("h1") == 0) & (c("h2") > 0)
    rows = years.where((c("n") >= 6) & (c("companies") >= 2) & (c("sources") >= 2)).withColumns({
        "late": late, "growth": growth, "fresh": fresh, "support": saturation(c("n"), 201),
        "diversity": clamp(0.45 + F.least(F.lit(0.30), c("companies") / 80) + F.least(F.lit(0.25), c("sources") / 12)),
    })
    emergence = F.when(c("fresh"), 1.0).otherwise(clamp(0.30 + 0.70 * c("late")))
    rows = rows.withColumns({"novelty": novelty(emergence, c("support"), c("growth"), c("sources"), c("n")), "confidence": trust_confidence(c("n"), c("sources"), clamp(c("quality")), F.lit(0.08), c("diversity"))})
    kept = rows.where((c("novelty") >= 0.52) & (c("confidence") >= 0.55) & (c("fresh") | ((c("growth") >= 0.54) & (c("late") >= 0.58))))
    w = Window.partitionBy("year").orderBy(F.desc(F.round("novelty", 9)), F.desc(F.round("growth", 9)), F.desc("n"), F.asc("title"))
    ranked = kept.withColumn("place", F.row_number().over(w)).where(c("place") <= top)
    r = lambda x: F.round(c(x), 5).alias(x)
    return ranked.select("year", "place", "title", "shown", "n", r("novelty"), r("growth"), r("late"), r("confidence"))


def target_years(years: DataFrame) -> DataFrame:
    """Years that were observed together with the year before."""
    seen = years.select("year").distinct()
    return seen.join(seen.select((F.col("year") + 1).alias("year")), "year", "left_semi")


def emerged_in_sample(train: DataFrame, sample: DataFrame, whole: DataFrame) -> DataFrame:
    """(title, n, estimate): titles of a held-out sample that rose over ``train``, counts scaled up to the whole year.

    A title of the sample counts when it is new, or when its estimate reaches 2 and 1.15 times
    what it was.
    """
    factor = whole.agg(F.sum("n").alias("a")).crossJoin(sample.agg(F.sum("n").alias("b"))).select((F.col("a") / F.greatest(F.col("b"), F.lit(1))).alias("factor"))  # one row each
    was = train.select("title", F.col("n").alias("was"))
    rows = sample.select("title", "n").join(was, "title", "left").crossJoin(F.broadcast(factor)).withColumns({"was": F.coalesce("was", F.lit(0)), "estimate": F.round(F.col("n") * F.col("factor"), 4)})
    return rows.where((F.col("was") == 0) | (F.col("estimate") >= F.greatest(F.lit(2.0), F.col("was") * 1.15))).select("title", "n", "estimate")
