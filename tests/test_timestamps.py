from __future__ import annotations

from pyspark.sql import functions as F

from jobweave.operators.timestamps import iso_utc, normalise_timestamps

FEEDS = [("cn", "Asia/Shanghai", "YMD"), ("eu", "Europe/Berlin", "DMY"), ("us", "America/New_York", "MDY"), ("in", "Asia/Kolkata", "DMY"), (None, "UTC", "YMD")]
CASES = [
    ("cn", "2024-05-06", None, "2024-05-05T16:00:00Z"),
    ("cn", " 2024/5/6 ", None, "2024-05-05T16:00:00Z"),
    ("cn", "２０２４年５月６日", None, "2024-05-05T16:00:00Z"),
    ("cn", "2024年5月6日 下午3点05分", None, "2024-05-06T07:05:00Z"),
    ("cn", "2024年5月6日 中午12点09分", None, "2024-05-06T04:09:00Z"),
    ("cn", "2024年5月6日 晚上11点27分", None, "2024-05-06T15:27:00Z"),
    ("cn", "8月14日", 2023, "2023-08-13T16:00:00Z"),
    ("cn", "8月14日", None, None),
    ("cn", "8月14日", 0, None),
    ("cn", "08-14 13:37", 2023, "2023-08-14T05:37:00Z"),
    ("cn", "20240506", 1999, "2024-05-05T16:00:00Z"),
    ("cn", "1766399423", None, "2025-12-22T10:30:23Z"),
    ("us", "1763397526868", None, "2025-11-17T16:38:46Z"),
    ("eu", "2024-05-06T10:00:00.987654+02:00[Europe/Berlin]", None, "2024-05-06T08:00:00Z"),
    ("eu", "Mon, 27 Jun 2022 01:31:53 +0800", None, "2022-06-26T17:31:53Z"),
    ("eu", "2026-01-30 04:43:03 CET", None, "2026-01-30T03:43:03Z"),
    ("us", "2024-01-02T03:04:05 GMT-5", None, "2024-01-02T08:04:05Z"),
    ("in", "2024-01-02T03:04:05 GMT+5:30", None, "2024-01-01T21:34:05Z"),
    ("eu", "03/04/2024", None, "2024-04-02T22:00:00Z"),
    ("us", "03/04/2024", None, "2024-03-04T05:00:00Z"),
    ("us", "3/12/2023 4:24 AM", None, "2023-03-12T08:24:00Z"),
    ("us", "December 18, 2024 12:17 PM EST", None, "2024-12-18T17:17:00Z"),
    ("us", "20 December 2023", None, "2023-12-20T05:00:00Z"),
    ("eu", "07-Oct-2025", None, "2025-10-06T22:00:00Z"),
    # twice: the earlier instant; never: moved by the gap
    ("us", "2024-11-03 01:30:00", None, "2024-11-03T05:30:00Z"),
    ("us", "2024-03-10 02:30:00", None, "2024-03-10T07:30:00Z"),
    ("eu", "2023-10-29 02:30", None, "2023-10-29T00:30:00Z"),
    ("cn", "CST 2024", None, None),
    ("us", "2024-07-01 00:00:00 CST", None, "2024-07-01T06:00:00Z"),
    ("cn", "2024-07-01 08:00:00 CST", None, "2024-07-01T00:00:00Z"),
    # impossible, wordy, empty
    ("cn", "2023-13-05", None, None),
    ("cn", "2023-02-29", None, None),
    ("eu", "31/11/2023", None, None),
    ("cn", "2024-05-06 25:00:00", None, None),
    ("us", "13/13/2024", None, None),
    ("us", "1/2/2024 13:05 PM", None, None),
    ("us", "12 Foo 2024", None, None),
    ("cn", "昨天", 2024, None),
    ("cn", "ASAP", 2024, None),
    ("cn", "", 2024, None),
    ("cn", "   ", 2024, None),
    ("cn", None, 2024, None),
    ("cn", "9" * 5000, 2024, None),
    # no home zone: only a stated one is readable
    ("other", "2024-05-06", None, None),
    (None, "2024-05-06", None, None),
    (None, "2024-05-06T00:00:00Z", None, "2024-05-06T00:00:00Z"),
]


def test_cases(spark):
    rows = [(k, feed, text, year, "x", "y") for k, (feed, text, year, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, source_dataset string, posting_date string, posting_year int, zone_name string, date_order string")
    feeds = spark.createDataFrame(FEEDS, "source_dataset string, zone_name string, date_order string")
    out = normalise_timestamps(df, feeds)
    assert out.columns[:6] == df.columns
    got = {r["id"]: r["utc"] for r in out.select("id", iso_utc(F.col("instant_utc")).alias("utc")).collect()}
    assert [(c, got[k]) for k, c in enumerate(CASES) if got[k] != c[3]] == []


def test_session_zone_repeats_and_empty_tables(spark):
    feeds = spark.createDataFrame([*FEEDS, ("cn", "Asia/Tokyo", "YMD")], "source_dataset string, zone_name string, date_order string")
    df = spark.createDataFrame([(1, "cn", "2024-05-06", 1), (1, "cn", "2024-05-06", 1)], "id int, source_dataset string, posting_date string, posting_year int")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r[0] for r in normalise_timestamps(df, feeds).select(iso_utc(F.col("instant_utc"))).collect()]
        big = [r[0] for r in normalise_timestamps(df, feeds, feed_limit=1).select(iso_utc(F.col("instant_utc"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == big == ["2024-05-05T16:00:00Z"] * 2
    assert normalise_timestamps(df.limit(0), feeds).count() == 0
    assert normalise_timestamps(df, feeds.limit(0)).where("instant_utc is not null").count() == 0


def test_against_an_independent_reader(spark):
    """Local times of every zone, a day around each change, against the zone data of the standard library."""
    from datetime import datetime, timedelta, timezone
    from zoneinfo import ZoneInfo

    rows, want = [], {}
    for feed, zone, _ in FEEDS[:4]:
        for start in (datetime(2024, 3, 9, 22), datetime(2024, 3, 30, 22), datetime(2024, 10, 26, 22), datetime(2024, 11, 2, 22)):
            for step in range(0, 30 * 4):
                local = start + timedelta(minutes=15 * step)
                rows.append((len(rows), feed, local.strftime("%Y-%m-%d %H:%M:%S"), None))
                want[len(rows) - 1] = local.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    df = spark.createDataFrame(rows, "id int, source_dataset string, posting_date string, posting_year int")
    feeds = spark.createDataFrame(FEEDS, "source_dataset string, zone_name string, date_order string")
    got = {r["id"]: r["u"] for r in normalise_timestamps(df, feeds).select("id", iso_utc(F.col("instant_utc")).alias("u")).collect()}
    assert got == want
