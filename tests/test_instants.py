import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brimfold.plans.catalog import FEED_INSTANTS
from brimfold.sources.tables import table
from brimfold.operators.instants import estimate_zone, normalise_instants, read_instants

UTC = dt.timezone.utc


def micros(text):
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp()) * 1_000_000 + dt.datetime.fromisoformat(text).microsecond


def run(spark, values, zone="UTC", day_first=True):
    at = dt.datetime(2026, 6, 1)
    df = spark.createDataFrame([(str(i), v, at) for i, v in enumerate(values)], "k string, v string, at timestamp")
    got = {r.row_key: r.utc_micros for r in normalise_instants(df, "k", "v", "at", zone, day_first).collect()}
    return [got.get(str(i)) for i in range(len(values))]


def test_forms(spark):
    cases = {
        "2026-08-25T02:02:31Z": "2026-08-25T02:02:31", " 2026-08-25T02:02:31Z ": "2026-08-25T02:02:31", "Fri, 13 Mar 2026 03:36:53 GMT": "2026-03-13T03:36:53", "2026-03-24T05:16:52+05:30": "2026-03-23T23:46:52",
        "2026-04-14 08:28:39.638": "2026-04-14T08:28:39.638000", "1794943202": "2026-11-17T19:20:02", "1775023019780": "2026-04-01T05:56:59.780000", "1783063752797500": "2026-07-03T07:29:12.797500", "1.794896460E9": "2026-11-17T06:21:00",
        "20260721T112042Z": "2026-07-21T11:20:42", "2026-03-26T05:54Z": "2026-03-26T05:54:00", "2026-03-06": "2026-03-06T00:00:00", "2026-07-09T02:05:16 America/New_York": "2026-07-09T06:05:16", "2026-03-23T12:30:44[Europe/Berlin]": "2026-03-23T11:30:44",
        "Jun 19, 2026 6:38 PM UTC": "2026-06-19T18:38:00", "Feb 23, 2026 12:11 AM UTC": "2026-02-23T00:11:00", "17.03.2026 18:30": "2026-03-17T18:30:00", "18.05.2026, 07:30 Uhr": "2026-05-18T07:30:00", "15. Januar 2026, 10:42": "2026-01-15T10:42:00",
        "3. März 2026, 20:08": "2026-03-03T20:08:00", "2.5.26 14:14": "2026-05-02T14:14:00", "2026-08-26 08:33:24 CEST": "2026-08-26T06:33:24", "2026-11-18 16:37:34 MEZ": "2026-11-18T15:37:34", "2026-07-14 07:54:42 EDT": "2026-07-14T11:54:42",
        "2026-11-09T11:10:13-07": "2026-11-09T18:10:13", "2026-09-16T11:45:43.214709Z": "2026-09-16T11:45:43.214709",
    }
    assert run(spark, list(cases)) == [micros(x) for x in cases.values()]


def test_no_instants(spark):
    assert run(spark, [None, "", "  ", "n/a", "-", "recently", "vor 3 Tagen", "31.11.2026 09:00", "2026-02-30T10:00:00Z", "2026-01-01T25:00:00Z", "2026-01-01T10:61:00Z", "2026-01-01T10:00:00 Mars/Base", "13/13/2026 10:00", "0:99"]) == [None] * 14


def test_slashes_follow_the_place(spark):
    assert run(spark, ["02/03/2026 05:36 AM"], day_first=False) == [micros("2026-02-03T05:36:00")]
    assert run(spark, ["02/03/2026 05:36"], day_first=True) == [micros("2026-03-02T05:36:00")]


def test_clock_changes(spark):
    # twice: the first; skipped: forward by the gap
    assert run(spark, ["25.10.2026 02:30", "29.03.2026 02:41"], "Europe/Berlin") == [micros("2026-10-25T00:30:00"), micros("2026-03-29T01:41:00")]
    assert run(spark, ["2026-11-01 01:30:00", "2026-03-08 02:16:10"], "America/New_York", False) == [micros("2026-11-01T05:30:00"), micros("2026-03-08T07:16:10")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.datetimes(dt.datetime(1975, 1, 1), dt.datetime(2099, 12, 31)), min_size=1, max_size=30))
def test_local_times_like_zoneinfo(spark, times):
    times = [t.replace(microsecond=0) for t in times]
    want = []
    for t in times:  # the first of two; forward by the gap
        aware = t.replace(tzinfo=ZoneInfo("Europe/Berlin"), fold=0)
        want.append(round((t - dt.datetime(1970, 1, 1) - aware.utcoffset()).total_seconds()) * 1_000_000)
    assert run(spark, [t.strftime("%d.%m.%Y %H:%M:%S") for t in times], "Europe/Berlin") == want


def fed(zones, n=3000):
    """Rows (key, text, ingested, site) whose zoneless texts are in the zone of their site."""
    r, rows = random.Random(4), []
    for i in range(n):
        site = sorted(zones)[i % len(zones)]
        t = dt.datetime(2026, 1, 1, tzinfo=UTC) + dt.timedelta(hours=3 * i, minutes=i % 60)
        seen = t + dt.timedelta(hours=1 + 24 * r.random())
        if i % 20 == 0:
            seen += dt.timedelta(days=40)
        text = t.isoformat() if r.random() < 0.5 else t.astimezone(ZoneInfo(zones[site])).strftime("%Y-%m-%d %H:%M:%S")
        rows.append((str(i), text, seen.replace(tzinfo=None), site, round(t.timestamp() * 1_000_000)))
    return rows


FED = "k string, v string, at timestamp, site string, want bigint"


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Asia/Tokyo"])
def test_the_zone_is_found_from_ingestion(spark, zone):
    read = read_instants(spark.createDataFrame(fed({"a": zone}), FED), "k", "v", "at", True)
    assert estimate_zone(read) == zone and estimate_zone(read, zone) == zone
    for wrong in ("UTC", "Europe/London", "Europe/Athens", "America/Chicago"):  # neighbours, too
        assert estimate_zone(read, wrong) == zone


def test_sites_of_other_zones(spark):
    zones = {"a": "America/New_York", "b": "Asia/Tokyo", "c": "America/New_York"}
    df = spark.createDataFrame(fed(zones, 6000), FED)
    got = normalise_instants(df, "k", "v", "at", by="site").join(df.select("k", "want"), F.col("row_key") == F.col("k"))
    assert got.where("utc_micros <> want").count() <= 2 and got.count() == 6000  # the second of a local hour that occurs twice


@pytest.mark.parametrize("folder, feeds", [("/root/testdata/sf0.01", FEED_INSTANTS), ("/root/testdata/sf0.1", FEED_INSTANTS)])
def test_the_zones_of_the_feeds_are_found(spark, folder, feeds):
    want = {"remotive": "UTC", "arbeitnow": "Europe/Berlin", "lever": "America/New_York"}
    found = {feed: estimate_zone(read_instants(table(spark, folder, feed, key, value, "fetched_at"), key, value, "fetched_at", day_first)) for feed, (key, value, day_first) in feeds.items()}
    assert found == want


def test_too_few_values_keep_the_declared_zone(spark):
    read = read_instants(spark.createDataFrame(fed({"a": "Europe/Berlin"}, 12), FED), "k", "v", "at", True)
    assert estimate_zone(read, "Europe/Athens") == "Europe/Athens"


def test_repeated_null_and_clashing(spark):
    a, b = dt.datetime(2026, 6, 1), dt.datetime(2026, 6, 2)
    df = spark.createDataFrame([("x", "2026-01-01Z", a), ("x", "2026-01-01T00:00:00Z", a), ("x", "2026-01-02T00:00:00Z", b), ("x", "n/a", None), (None, "2026-01-01", a), ("y", "2026-01-05", None)], "k string, v string, at timestamp")
    df = df.withColumns({"_text": F.lit(1), "_clock": F.lit(2), "_zone": F.lit("q"), "_key": F.lit(0)})
    assert sorted(map(tuple, normalise_instants(df, "k", "v", "at", "UTC").collect())) == [("x", micros("2026-01-02T00:00:00")), ("y", micros("2026-01-05T00:00:00"))]
    assert normalise_instants(df.limit(0), "k", "v", "at").collect() == []
