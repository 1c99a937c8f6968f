import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from driftwell.operators import timestamps as T

CASES = [
    # value, hint, default, month first, expected
    ("2024-05-07T03:37:00Z", None, "Asia/Tokyo", False, "2024-05-07T03:37:00Z"),
    ("2021-04-19T07:00:00+02:00", "Europe/Paris", "America/Sao_Paulo", False, "2021-04-19T05:00:00Z"),
    ("20240812T041602-0330", None, "UTC", False, "2024-08-12T07:46:02Z"),
    ("2025-10-11T06:50:14.999999+00:00", None, "Asia/Tokyo", False, "2025-10-11T06:50:14Z"),
    ("1726752051200", None, "Asia/Tokyo", False, "2024-09-19T13:20:51Z"),
    ("1745955136", None, None, False, "2025-04-29T19:32:16Z"),
    ("Wed, 16 Nov 2022 03:14:36 -0300", None, None, False, "2022-11-16T06:14:36Z"),
    ("Tue, 08 Aug 2023 22:43:26 GMT", None, "Asia/Tokyo", False, "2023-08-08T22:43:26Z"),
    ("2024-11-15 14:23 BRT", None, None, False, "2024-11-15T17:23:00Z"),
    ("2024-04-30 00:12 UTC-03:00", None, None, False, "2024-04-30T03:12:00Z"),
    ("2026-07-04T04:56+09:00[Asia/Tokyo]", None, "America/New_York", False, "2026-07-03T19:56:00Z"),
    ("23 de junho de 2024 às 15h48", None, "America/Sao_Paulo", False, "2024-06-23T18:48:00Z"),
    ("27 de marzo de 2023 a las 22:53", None, "America/Argentina/Buenos_Aires", False, "2023-03-28T01:53:00Z"),
    ("1er mai 2023", None, "Europe/Paris", False, "2023-05-01"),
    ("13. Januar 2026, 10:23 Uhr", None, "Europe/Berlin", False, "2026-01-13T09:23:00Z"),
    ("May 28, 2025 12:12 AM", None, "America/New_York", True, "2025-05-28T04:12:00Z"),
    ("令和元年5月1日", None, "Asia/Tokyo", False, "2019-05-01"),
    ("2026年4月5日 19時25分", None, "Asia/Tokyo", False, "2026-04-05T10:25:00Z"),
    ("２０２２／０７／１５ １６：２９", None, "Asia/Tokyo", False, "2022-07-15T07:29:00Z"),
    ("03/04/2024", None, "America/New_York", True, "2024-03-04"),
    ("03/04/2024", None, "Europe/Paris", False, "2024-04-03"),
    ("12/12/25", None, "Europe/Paris", False, "2025-12-12"),
    (" 2023-09-24 00:09 ", "GMT+09:00", "America/Sao_Paulo", False, "2023-09-23T15:09:00Z"),
    ("2023-09-24 00:09", "heure de Paris", "America/Sao_Paulo", False, "2023-09-23T22:09:00Z"),
    ("2023-09-24 00:09", "America/New York", "Asia/Tokyo", False, "2023-09-24T04:09:00Z"),
    ("2023-09-24 00:09", "TBD", "Asia/Tokyo", False, "2023-09-23T15:09:00Z"),
    ("2023-09-24 00:09", None, None, False, "2023-09-24T00:09:00Z"),
    # skipped and doubled wall times
    ("2025-03-09 02:30", None, "America/New_York", True, "2025-03-09T07:30:00Z"),
    ("2025-11-02 01:30", None, "America/New_York", True, "2025-11-02T05:30:00Z"),
    # no time at all
    ("2024-02-30", None, "UTC", False, None),
    ("31/02/2025", None, "UTC", False, None),
    ("14/03/2025", None, "America/New_York", True, None),
    ("0000-00-00T00:00:00", None, "UTC", False, None),
    ("2024-05-05T25:00:00", None, "UTC", False, None),
    ("TBA", None, "UTC", False, None),
    ("未定", None, "UTC", False, None),
    ("", None, "UTC", False, None),
    (None, None, None, None, None),
    ("x" * 100_000, None, "UTC", False, None),
]


@pytest.fixture(scope="module")
def got(spark):
    rows = [(i, *c[:4], "kept", "kept") for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, value string, hint string, zone string, mf boolean, y string, local string")
    return {r.i: r for r in T.normalise(df, "value", hint="hint", default="zone", month_first="mf").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(got, i):
    assert got[i].utc == CASES[i][4], CASES[i]
    assert (got[i].y, got[i].local) == ("kept", "kept")


def test_days_match_the_calendar(spark):
    days = [(dt.date(1970, 1, 1) + dt.timedelta(days=k),) for k in range(-80000, 120000, 997)]
    df = spark.createDataFrame([(d.year, d.month, d.day, (d - dt.date(1970, 1, 1)).days) for (d,) in days], "y int, m int, d int, k long")
    assert df.filter(T.days_from_civil(df.y, df.m, df.d) != df.k).count() == 0


def test_wall_times_match_zoneinfo(spark):
    """Brute force over both changes of a year, every 15 minutes, in several zones."""
    rows = []
    for zone in ("Europe/Paris", "America/New_York", "Australia/Sydney", "Asia/Tokyo"):
        for start in (dt.datetime(2025, 3, 29, 22), dt.datetime(2025, 10, 25, 22), dt.datetime(2025, 3, 8, 22), dt.datetime(2025, 11, 1, 22), dt.datetime(2025, 4, 5, 12), dt.datetime(2025, 10, 4, 12)):
            for k in range(40):
                t = start + dt.timedelta(minutes=15 * k)
                want = t.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(dt.timezone.utc)
                rows.append((t.strftime("%Y-%m-%d %H:%M"), zone, want.strftime("%Y-%m-%dT%H:%M:%SZ")))
    df = spark.createDataFrame(rows, "value string, zone string, want string")
    assert T.normalise(df, "value", default="zone").filter("utc is distinct from want").collect() == []


def test_copies_count_once_and_empty_tables(spark, data):
    t = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    args = [t("items"), t("item_events"), t("news_records"), t("sources")]
    out = T.readable_times(*args).collect()
    assert len(out) == len({(r.field, r.row_key) for r in out}) > 300
    assert T.readable_times(*[a.limit(0) for a in args]).collect() == []


def test_long_bracketed_zone(spark):
    """However long the zone in brackets is, the value is read; a zone of no name gives way to the offset."""
    values = [f"2026-07-04T04:56+09:00[{'x' * n}]" for n in (10, 280, 400, 100_000)]
    df = spark.createDataFrame([(v, "UTC") for v in values], "value string, zone string")
    assert [r.utc for r in T.normalise(df, "value", default="zone").collect()] == ["2026-07-03T19:56:00Z"] * 4
