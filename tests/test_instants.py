import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from conftest import rows

from quaestor.operators.instants import timestamp_cases, to_instants, zone_segments
from quaestor.runtime import table


def _cases(spark, make_root, field, values):
    root = make_root(offers=[dict(offer_row=i, **{field: v}) for i, v in enumerate(values)])
    return {r.offer_row: r.utc for r in timestamp_cases(table(spark, root, "offers")).collect()}


def test_publication_dates(spark, make_root):
    values = ["18/05/2025", None, "", "  ", "31/04/2025", "16/03/25", "20250413", "7 octobre 2025", "lundi 1er juin 2026", "Dec 7, 2024", "16 شتنبر 2025", "12/2025", "1740663906", "1754764455984", "20240912T140053Z", "Fri, 24 Jan 2025 08:27:21 -0500", "x" * 50_000]
    got = _cases(spark, make_root, "date_publication", values)
    assert got == {
        3: "unreadable", 4: "unreadable", 5: "2025-03-16T00:00:00Z", 6: "2025-04-12T23:00:00Z", 7: "2025-10-06T23:00:00Z", 8: "2026-05-31T23:00:00Z", 9: "2024-12-06T23:00:00Z",
        10: "2025-09-15T23:00:00Z", 11: "unreadable", 12: "2025-02-27T13:45:06Z", 13: "2025-08-09T18:34:15Z", 14: "2024-09-12T14:00:53Z", 15: "2025-01-24T13:27:21Z", 16: "unreadable",
    }


def test_arabic_digits_are_read(spark, make_root):
    got = _cases(spark, make_root, "date_publication", ["١٠/٠٤/٢٠٢٥", "۱۶ شتنبر ۲۰۲۵", "١٧٤٠٦٦٣٩٠٦", "٣١/٠٤/٢٠٢٥", "10/04/2025"])
    assert got == {0: "2025-04-09T23:00:00Z", 1: "2025-09-15T23:00:00Z", 2: "2025-02-27T13:45:06Z", 3: "unreadable"}
    assert _cases(spark, make_root, "date_limite", ["١٨/٠١/٢٠٢٦ ١٥:٣٠"]) == {0: "2026-01-18T14:30:00Z"}


def test_far_years_agree_with_zoneinfo(spark, make_root):
    assert _cases(spark, make_root, "date_publication", ["31/12/9999", "01/01/1900", "9999-12-31"]) == {2: "9999-12-30T23:00:00Z"}
    given = [(f"{y:04}-{m:02}-{d:02} {h:02}:30:00", zone) for y in (2, 1799, 1800, 1913, 1940, 2100, 2128, 2129, 2200, 2399, 2400, 2999, 9998) for m, d in ((1, 1), (3, 29), (7, 1), (10, 28), (12, 31)) for h in (0, 2, 23) for zone in ("Europe/Paris", "Africa/Casablanca", "Australia/Sydney", "America/Santiago")]
    got = to_instants(spark.createDataFrame(given, "v string, tz string"), "v", "tz").selectExpr("v", "tz", "unix_seconds(utc) AS s").collect()
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    want = {(v, z): (dt.datetime.fromisoformat(v).replace(tzinfo=ZoneInfo(z)) - epoch) // dt.timedelta(seconds=1) for v, z in given}
    assert {(r.v, r.tz): r.s for r in got} == want


def test_doubtful_moroccan_hours(spark, make_root):
    # Ramadan 2025: the clock fell from 3:00 to 2:00 on 23 February and sprang from 2:00 to 3:00 on 6 April
    got = _cases(spark, make_root, "date_limite", ["23/02/2025 02:30", "06/04/2025 02:30", "06/04/2025 03:30", "13/09/2024 09:00 AM", "2026-03-29 02:30 Europe/Paris", "2026-01-01 10:00 Mars/Olympus"])
    assert got == {0: "2025-02-23T01:30:00Z", 1: "2025-04-06T02:30:00Z", 3: "2024-09-13T08:00:00Z", 4: "2026-03-29T01:30:00Z", 5: "unreadable"}


@pytest.mark.parametrize("zone", ["Africa/Casablanca", "Europe/Paris", "America/St_Johns", "Australia/Lord_Howe"])
def test_segments_agree_with_zoneinfo(zone):
    info, parts = ZoneInfo(zone), zone_segments(zone)
    for hour in range(0, 24 * 3 * 365, 7):
        local = dt.datetime(2023, 1, 1, 0, 30) + dt.timedelta(hours=hour)
        second = int(local.replace(tzinfo=dt.timezone.utc).timestamp())
        lo, hi, matches, offset = next(p for p in parts if p[0] <= second < p[1])
        a, b = (local.replace(tzinfo=info, fold=f).utcoffset().total_seconds() for f in (0, 1))
        assert offset == a
        assert matches == (1 if a == b else 2 if a > b else 0)


def test_extra_columns_and_empty_input(spark):
    df = spark.createDataFrame([("2025-01-01 10:00", "UTC", "z", 1)], "v string, tz string, zone string, year int")
    got = to_instants(df, "v", "tz").collect()[0]
    assert (got.zone, got.year, str(got.utc)) == ("z", 1, "2025-01-01 10:00:00")
    assert to_instants(df.limit(0), "v", "tz").count() == 0


def test_empty_table(spark, make_root):
    assert rows(timestamp_cases(table(spark, make_root(), "offers"))) == []
