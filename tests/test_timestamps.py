import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from loomfeed.operators.timestamps import normalise_timestamps, restated_timestamps

CASES = [
    ("2025-10-05T22:00:20Z", "alpha", "2025-10-05T22:00:20Z"),
    ("\t2025-10-05T22:00:20z\n", "alpha", "2025-10-05T22:00:20Z"),
    ("2025-10-05T22:34:08-04:00", "berlin", "2025-10-06T02:34:08Z"),
    ("2025-10-06T05:22:24+00", "berlin", "2025-10-06T05:22:24Z"),
    ("2025-10-05T02:45:19,524+0530", "berlin", "2025-10-04T21:15:19Z"),
    ("2025-10-06T12:22:19+11:00[Australia/Sydney]", "berlin", "2025-10-06T01:22:19Z"),
    ("2025-10-06 13:26:16 America/Los_Angeles", "berlin", "2025-10-06T20:26:16Z"),
    ("2025-10-06 13:26:16 Nowhere/Land", "berlin", None),
    ("20251006T030445Z", "alpha", "2025-10-06T03:04:45Z"),
    ("20250913", "berlin", "2025-09-12T22:00:00Z"),
    ("1759757851", "berlin", "2025-10-06T13:37:31Z"),
    ("1755766464.532", "alpha", "2025-08-21T08:54:24Z"),
    ("1759571816317", "alpha", "2025-10-04T09:56:56Z"),
    ("1759736450871615", "alpha", "2025-10-06T07:40:50Z"),
    ("10/13/2025 3:47 PM", "alpha", "2025-10-13T15:47:00Z"),
    ("13/10/2025 3:47 PM", "alpha", None),
    ("13/10/2025 3:47 PM", "berlin", "2025-10-13T13:47:00Z"),
    ("06.10.2025 12:09:52", "berlin", "2025-10-06T10:09:52Z"),
    ("12/1/2025 12:05 AM", "alpha", "2025-12-01T00:05:00Z"),
    ("12/1/2025 13:05 PM", "alpha", None),
    ("Sun, 05 Oct 2025 04:48:00 EDT", "berlin", "2025-10-05T08:48:00Z"),
    ("Tue, 4 Nov 25 20:59 +0530", "berlin", "2025-11-04T15:29:00Z"),
    ("04 Nov 2025 10:20:00 UT", "berlin", "2025-11-04T10:20:00Z"),
    ("Nov 19, 2025 12:44 PM", "alpha", "2025-11-19T12:44:00Z"),
    ("21. Oktober 2025, 12:46 Uhr", "berlin", "2025-10-21T10:46:00Z"),
    ("5 octobre 2025 à 23:46", "berlin", "2025-10-05T21:46:00Z"),
    ("2 de noviembre de 2025, 15:55", "berlin", "2025-11-02T14:55:00Z"),
    ("2025-10-26T02:30:00", "berlin", "2025-10-26T00:30:00Z"),  # occurs twice: the first
    ("2026-03-29T02:30:00", "berlin", "2026-03-29T01:30:00Z"),  # skipped: the offset before
    ("31/02/2026 09:10", "berlin", None),
    ("2025-10-05T25:00:00Z", "alpha", None),
    ("2025-10-05T12:60", "alpha", None),
    ("2025-10-05T12:00:60", "alpha", None),
    ("2026-W", "alpha", None), ("TBD", "alpha", None), ("", "alpha", None), ("   ", "alpha", None), (None, "alpha", None), ("0000-00-00 00:00:00", "alpha", None), ("x" * 100_000, "alpha", None),
]


@pytest.fixture(scope="module")
def clock(spark):
    return spark.createDataFrame([(" Berlin ", "Europe/Berlin", True), ("berlin", "Europe/Berlin", True), (None, "Asia/Tokyo", False)], "source_id string, tz_name string, day_first boolean")


def test_cascade(spark, clock):
    df = spark.createDataFrame([(i, s, v, "x") for i, (v, s, _) in enumerate(CASES)], "id int, source_id string, published_at string, tz_name string")
    got = {r.id: r.published_at_utc for r in normalise_timestamps(df, clock, ["published_at"]).collect()}
    for i, (value, source, want) in enumerate(CASES):
        have = got[i].strftime("%Y-%m-%dT%H:%M:%SZ") if got[i] else None
        assert have == want, (value, source)


def test_restated_rows_only(spark, clock):
    df = spark.createDataFrame([(1, "BERLIN", "2025-10-05T22:00:20Z", " 2025-10-05T22:00:20Z"), (2, None, None, "2025-10-05")], "article_id long, source_id string, published_at string, updated_at string")
    got = sorted(map(tuple, restated_timestamps(df, clock, "article_id", ["published_at", "updated_at"]).collect()))
    assert got == [(1, "updated_at", "2025-10-05T22:00:20Z"), (2, "updated_at", "2025-10-05T00:00:00Z")]
    assert restated_timestamps(df.limit(0), clock.limit(0), "article_id", ["published_at", "updated_at"]).count() == 0


@pytest.mark.parametrize("zone", ["America/New_York", "Australia/Sydney", "Asia/Kolkata"])
def test_against_the_zone_database(spark, zone):
    start = dt.datetime(2025, 1, 1)
    walls = [start + dt.timedelta(hours=7 * k, minutes=11) for k in range(1300)]
    df = spark.createDataFrame([(i, "s", w.strftime("%Y-%m-%d %H:%M")) for i, w in enumerate(walls)], "id int, source_id string, v string")
    clock = spark.createDataFrame([("s", zone, False)], "source_id string, tz_name string, day_first boolean")
    got = {r.id: r.v_utc for r in normalise_timestamps(df, clock, ["v"]).collect()}
    for i, w in enumerate(walls):
        want = w.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(dt.timezone.utc).replace(tzinfo=None)
        assert got[i] == want, w


def test_session_zone_plays_no_part(spark, clock):
    df = spark.createDataFrame([(1, "berlin", "2025-10-26T02:30:00")], "id int, source_id string, v string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert restated_timestamps(df, clock, "id", ["v"]).first().ts_utc == "2025-10-26T00:30:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
