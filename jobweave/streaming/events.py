"""Event streams: the same expressions over a table and over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", lateness: str | None = None, time_col: str = "ts") -> DataFrame:
    """(window_start, event_type, events, users, value): tumbling windows by type.

    On a stream ``lateness`` bounds how long a window stays open; users are then counted
    approximately, as exact distinct counts would need unbounded state.
    """
    if lateness is not None:
        events = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, lateness)
    users = F.approx_count_distinct("user_id") if events.isStreaming else F.countDistinct("user_id")
    grouped = events.groupBy(F.window(time_col, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), users.alias("users"), F.round(F.sum("value"), 4).alias("value"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "events", "users", "value")


def sessions(events: DataFrame, gap_minutes: int = 30, time_col: str = "ts") -> DataFrame:
    """(user_id, session, events, first_ts, last_ts): runs of a user's events without a pause longer than the gap."""
    w = Window.partitionBy("user_id").orderBy(time_col, "event_id")
    pause = F.timestamp_diff("SECOND", F.lag(time_col).over(w), F.col(time_col))
    numbered = events.select("user_id", "event_id", time_col, F.when(pause.isNull() | (pause > gap_minutes * 60), 1).otherwise(0).alias("new"))
    numbered = numbered.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.min(time_col).alias("first_ts"), F.max(time_col).alias("last_ts"))


def half_day_momentum(events: DataFrame, time_col: str = "ts") -> DataFrame:
    """Per day and type: events before and after noon and whether the day gains (above 0.5) or loses."""
    am, pm = F.count_if(F.hour(time_col) < 12), F.count_if(F.hour(time_col) >= 12)
    grouped = events.groupBy(F.to_date(time_col).cast("string").alias("day"), "event_type").agg(am.alias("am"), pm.alias("pm"))
    return grouped.withColumn("momentum", F.round(F.least(F.greatest(0.5 + 0.5 * (F.col("pm") - F.col("am")) / (F.col("pm") + F.col("am")), F.lit(0.0)), F.lit(1.0)), 6))


def property_sums(events: DataFrame, key: str = "k") -> DataFrame:
    """Per type: a number out of the JSON properties, unreadable ones as null."""
    value = F.get_json_object("props", f"$.{key}").try_cast("double")
    return events.groupBy("event_type").agg(F.count(value).alias("stated"), F.round(F.sum(value), 4).alias("total"), F.max(value).alias("largest"))
