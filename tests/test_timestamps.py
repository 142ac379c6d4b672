from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from wachbuch.operators import timestamps

CASES = [
    ("08.06.24, 11.10 Uhr", "2024-06-08 09:10:00"), (" 08.06.26,\xa001.25Uhr ", "2026-06-07 23:25:00"), ("4.6.24, 18 bis 22 Uhr", "2024-06-04 16:00:00"),
    ("16.09.2024 zwischen 08.15 Uhr und 10.15 Uhr", "2024-09-16 06:15:00"), ("2024-12-01T10:25:00+09:00", "2024-12-01 01:25:00"), ("2026-07-30T17:25:17+0200", "2026-07-30 15:25:17"),
    ("1772236225081", "2026-02-27 23:50:25"), ("20241117T002500", "2024-11-16 23:25:00"), ("Apr 25, 2025 8:05 PM CEST", "2025-04-25 18:05:00"), ("Jan 1, 2026 12:30 AM", "2025-12-31 23:30:00"),
    ("Mon, 17 Mar 2025 14:25:26 GMT", "2025-03-17 14:25:26"), ("Donnerstag, 06.02.2025", "2025-02-06"), ("2025-11-26 14:15 Europe/Berlin", "2025-11-26 13:15:00"), ("06.04.2025 14.50 Uhr (UTC)", "2025-04-06 14:50:00"),
    ("26.10.2025, 02.30 Uhr", "2025-10-26 00:30:00"), ("30.03.2025, 02.30 Uhr", "2025-03-30 01:30:00"), ("29. Februar 2024", "2024-02-29"),
    ("31.02.2025, 17 Uhr", None), ("30.04.??", None), ("09.03.224", None), ("März 2024", None), ("", None), ("unbekannt", None), ("01.01.2024, 25.00 Uhr", None), (None, None),
]


def press(spark, rows):
    return spark.createDataFrame(rows, "rec_id long, zeit_raw string, publish_date string, ts_instant string, raw string, field string")


def test_formats(spark):
    got = {r.rec_id: r.norm for r in timestamps.found(press(spark, [(k, raw, None, "x", "y", "z") for k, (raw, _) in enumerate(CASES)])).collect()}
    assert {k: got.get(k) for k in range(len(CASES))} == {k: want for k, (_, want) in enumerate(CASES)}


@pytest.mark.parametrize(("raw", "want"), [("2024-01-11T23:30:00Z", "2024-01-12"), ("2025-02-02 19:27:00 -0500", "2025-02-03"), ("(31.03.26)", "2026-03-31"), ("08/2025", None), ("9.1.2025, 23:52 Uhr", "2025-01-09")])
def test_publish_day(spark, raw, want):
    got = timestamps.found(press(spark, [(1, None, raw, None, None, None)])).collect()
    assert [r.norm for r in got] == ([want] if want else [])


def test_every_half_hour_of_two_years_against_the_standard_library(spark):
    zone, rows = ZoneInfo("Europe/Berlin"), []
    for k in range(0, 2 * 366 * 48, 7):
        rows.append((k, datetime(2024, 1, 1) + timedelta(minutes=30 * k)))
    df = spark.createDataFrame([(k, t.strftime("%Y-%m-%d %H:%M")) for k, t in rows], "id long, raw string")
    got = {r.id: r.ts_instant for r in timestamps.normalize(df, "raw").collect()}
    assert all(got[k] == int(t.replace(tzinfo=zone).timestamp()) for k, t in rows)


def test_empty_and_repeated(spark):
    assert timestamps.found(press(spark, [])).count() == 0
    assert timestamps.found(press(spark, [(1, "1.1.24", None, None, None, None)] * 2)).count() == 2
