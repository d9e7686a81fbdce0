from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from corpuskiln.operators import instants as I

NY = [
    ("Fri, 08 Nov 2024 14:28:17 -0500", "2024-11-08 19:28:17"), ("Fri, 12 Dec 2014 19:47:17 EST", "2014-12-13 00:47:17"), ("2016-11-24T12:17:34-05:00", "2016-11-24 17:17:34"), ("Wed Mar 28 11:40:16 2012", "2012-03-28 15:40:16"),
    ("Fri Dec  6 10:56:10 2019", "2019-12-06 15:56:10"), ("2016-03-13 03:34:53-04", "2016-03-13 07:34:53"), ("20150103T151440Z", "2015-01-03 15:14:40"), ("20241201T191832-0600", "2024-12-02 01:18:32"), ("25. Dezember 2012, 03:20 Uhr", "2012-12-25 08:20:00"),
    ("02/14/22 5:08 PM", "2022-02-14 22:08:00"), ("12/1/22 12:05 AM", "2022-12-01 05:05:00"), ("Oct 29, 2018 at 2:35:50 PM", "2018-10-29 18:35:50"), ("11 February 2020, 19:09:10 PST", "2020-02-12 03:09:10"), ("2017-08-31 15:42:22.1234567Z", "2017-08-31 15:42:22.123456"),
    ("2017-03-12T02:30", "2017-03-12 07:30:00"), ("2017-11-05 01:30:00", "2017-11-05 05:30:00"), ("calculated: 2022-01-29", "2022-01-29 05:00:00"), ("20170605", "2017-06-05 04:00:00"), ("2019-03-13", "2019-03-13 04:00:00"),
    ("1434543338126", "2015-06-17 12:15:38.126"), ("1434543338", "2015-06-17 12:15:38"), ("630338871", "2020-12-22 14:07:51"), ("395333714873927000", "2013-07-12 14:55:14.873927"), ("Wed, 22 Aug 2018 10:42:11 -0400 (EDT)", "2018-08-22 14:42:11"),
    ("31/31/2020 10:00", None), ("Tue, 10 Mar", None), ("T14:05:09", None), ("2019-02-30", None), ("2019-02-20 25:00", None), ("0000-00-00 00:00:00", None), ("", None), ("  ", None), (None, None), ("yesterday evening", None), ("13:00 PM 2020-01-01", None), ("123", None), ("9" * 30, None), ("x" * 20000, None),
]


def read(spark, texts, zone, order):
    df = I.read_texts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t")
    got = df.select("i", F.timestamp_micros(I.instant(F.lit(zone), F.lit(order))).cast("string").alias("x")).collect()
    return [r.x for r in sorted(got)]


def test_formats(spark):
    assert read(spark, [t for t, _ in NY], "America/New_York", "MDY") == [w for _, w in NY]


def test_order_and_local_abbreviations(spark):
    assert read(spark, ["3.4.2020 10:00", "1.2.21 00:00", "2 Jan 2017, 10:40:43 CET"], "Europe/Berlin", "DMY") == ["2020-04-03 08:00:00", "2021-02-01 00:00:00".replace("2021-02-01 00", "2021-01-31 23"), "2017-01-02 09:40:43"]
    assert read(spark, ["5 Jul 2014, 09:00:00 IST"], "Asia/Kolkata", "DMY") == ["2014-07-05 03:30:00"]


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin", "Australia/Sydney", "Asia/Kathmandu"])
def test_wall_times_like_the_zone_database(spark, zone):
    z = ZoneInfo(zone)
    walls = [datetime(2016, 1, 1) + timedelta(hours=5 * k, minutes=k % 60) for k in range(2000)]
    want = []
    for w in walls:
        u = w.replace(tzinfo=z, fold=0).astimezone(timezone.utc)  # the first of two; a skipped time moves on by the skipped span
        want.append(u.strftime("%Y-%m-%d %H:%M:%S"))
    assert read(spark, [w.strftime("%Y-%m-%dT%H:%M:%S") for w in walls], zone, "MDY") == want


def test_missing_zone_is_estimated(spark):
    z = ZoneInfo("Asia/Kolkata")
    rows = []
    for k in range(300):
        u = datetime(2015, 1, 1, tzinfo=timezone.utc) + timedelta(hours=3 * k)
        text = u.strftime("%Y-%m-%dT%H:%M:%SZ") if k % 2 else u.astimezone(z).strftime("%Y-%m-%d %H:%M:%S")
        rows.append(("lost", k, text))
    df = spark.createDataFrame(rows, "source string, seq int, t string").withColumn("ingested_us", F.lit(None).cast("long"))
    got = I.estimate_zones(I.read_texts(df, "t"), ["America/New_York", "Asia/Kolkata", "Europe/Berlin", "UTC"]).collect()
    assert [(r.source, r.zone_id, r.violations) for r in got] == [("lost", "Asia/Kolkata", 0)]
    zones = spark.createDataFrame([("other", "Asia/Kolkata", "DMY"), ("else", "UTC", "DMY")], "source string, zone_id string, date_order string")
    done = I.normalise(df.drop("ingested_us"), "t", F.col("source"), zones, F.col("seq"))
    us = [r.instant_us for r in done.orderBy("seq").collect()]
    assert us == [1420070400000000 + k * 3 * 3600 * 10**6 for k in range(300)]


def test_offsets_and_impossible_orders_speak(spark):
    # without any sequence: stated offsets name the zone, a day above 12 the order
    z = ZoneInfo("Europe/Berlin")
    rows = []
    for k in range(120):
        u = (datetime(2015, 1, 1, tzinfo=timezone.utc) + timedelta(days=9 * k, hours=k)).astimezone(z)
        rows.append((str(k), f"/box/{k}", u.isoformat() if k % 2 else u.strftime("%d.%m.%Y %H:%M"), int(u.timestamp()) * 10**6 if k % 2 else int(u.replace(second=0, fold=0).timestamp()) * 10**6))
    notes = spark.createDataFrame([r[:3] for r in rows], "id string, source_file string, created_at string")
    zones = spark.createDataFrame([("parsed_notes", "a", "Europe/Berlin", "DMY"), ("parsed_notes", "b", "America/New_York", "MDY"), ("messages", "c", "Asia/Tokyo", "MDY"), ("messages", "c", "UTC", "MDY"), ("messages", None, "UTC", None)], "tbl string, source_key string, zone_id string, date_order string")
    got = {r.id: r.instant_us for r in I.note_instants(notes, zones).collect()}
    assert got == {r[0]: r[3] for r in rows}
    e = I.zone_estimates(I.dated_rows(notes=notes), zones).first()
    assert (e.source, e.zone_id, e.date_order, e.declared_zone, e.violations) == ("parsed_notes:box", "Europe/Berlin", "DMY", None, 0)


def test_no_rows_and_no_zones(spark):
    notes = spark.createDataFrame([("1", "/box/1", "2020-01-01"), ("2", None, "2020-01-01T00:00:00Z"), ("3", "/box/3", None)], "id string, source_file string, created_at string")
    none = spark.createDataFrame([], "tbl string, source_key string, zone_id string, date_order string")
    assert [(r.id, r.instant_us) for r in I.note_instants(notes, none).collect()] == [("2", 1577836800000000)]
    assert I.note_instants(notes.limit(0), none).count() == 0
