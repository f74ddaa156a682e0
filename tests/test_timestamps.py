"""Moments in many spellings against Python's own calendar and zones."""

import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import functions as F

from lumatable.functions.instants import number_us
from lumatable.operators.timestamps import found, offset_seconds, text_instants, zone_intervals


def us(*parts, zone=UTC, micro=0, fold=0):
    return int(datetime(*parts, tzinfo=zone, fold=fold).timestamp()) * 1_000_000 + micro


BERLIN = ZoneInfo("Europe/Berlin")
CASES = [
    # text, offset_time, time_zone, expected
    ("2012:01:02 02:06:18", None, None, us(2012, 1, 2, 2, 6, 18)),
    ("2012:01:02 02:06:18", "+05:30", "Europe/Berlin", us(2012, 1, 1, 20, 36, 18)),
    ("2012-07-02T02:06:18Z", "+05:30", "Europe/Berlin", us(2012, 7, 2, 2, 6, 18)),
    ("2012-07-02T02:06:18+0100", None, None, us(2012, 7, 2, 1, 6, 18)),
    ("2012-07-02T02:06:18-08", None, None, us(2012, 7, 2, 10, 6, 18)),
    ("2012-07-02T02:06:18.45+02:00[Europe/Berlin]", None, None, us(2012, 7, 2, 0, 6, 18, micro=450_000)),
    ("2012-07-02 02:06:18 CEST", None, None, us(2012, 7, 2, 0, 6, 18)),
    ("20120710T164522Z", None, None, us(2012, 7, 10, 16, 45, 22)),
    ("20141114_022759 ", None, None, us(2014, 11, 14, 2, 27, 59)),
    ("02.07.2012 02:06:18", None, "Europe/Berlin", us(2012, 7, 2, 2, 6, 18, zone=BERLIN)),
    ("2.7.12 02:06", None, None, us(2012, 7, 2, 2, 6)),
    ("07/02/2012 02:06:18 PM", None, None, us(2012, 7, 2, 14, 6, 18)),
    ("1/11/2012 12:07 AM", None, None, us(2012, 1, 11, 0, 7)),
    ("Wed, 11 Jan 2012 11:38:10 +0100", None, None, us(2012, 1, 11, 10, 38, 10)),
    ("7 Apr 2012 11:56:06 -0330", None, None, us(2012, 4, 7, 15, 26, 6)),
    ("'2012-01-11'", None, None, us(2012, 1, 11)),
    ("  2012:01:11 12:24:50\x00", None, "Local", us(2012, 1, 11, 12, 24, 50)),
    ("1326277725", "+05:00", "Asia/Tokyo", 1_326_277_725_000_000),
    ("1325501504398", None, None, 1_325_501_504_398_000),
    # a repeated hour is the earlier instant, a skipped hour takes the offset before the change
    ("2019:10:27 02:30:00", None, "Europe/Berlin", us(2019, 10, 27, 0, 30)),
    ("2019:03:31 02:30:00", None, "Europe/Berlin", us(2019, 3, 31, 1, 30)),
    ("2019:03:10 02:30:00", None, "america/new_york", us(2019, 3, 10, 7, 30)),
    ("2019:04:07 01:45:00", None, "Australia/Lord_Howe", us(2019, 4, 6, 14, 45)),
    ("2005-07-01 12:00:00", None, "America/New_York", us(2005, 7, 1, 16)),
    ("1987-07-01 12:00:00", None, "Europe/Berlin", us(1987, 7, 1, 10)),
    ("2031-07-01 12:00:00", None, "Europe/Berlin", us(2031, 7, 1, 10)),
    ("2011-12-30 12:00:00", None, "Pacific/Apia", us(2011, 12, 30, 22)),
    ("1950-01-01 12:00:00", None, "Europe/Berlin", us(1950, 1, 1, 11)),
    ("2012:01:11 12:24:50", "   :  ", "Asia/Kathmandu", us(2012, 1, 11, 6, 39, 50)),
    ("2012:01:11 12:24:50", "+25:00", None, us(2012, 1, 11, 12, 24, 50)),
    ("2019-06-31 12:00:00", None, None, None),
    ("2022-02-29T10:00:00Z", None, None, None),
    ("2020-02-29T24:00:00", None, None, None),
    ("20231340_120000", None, None, None),
    ("0000:00:00 00:00:00", None, None, None),
    ("2018:11", None, None, None),
    ("13/01/2012 10:00 AM", None, None, None),
    ("01/13/2012 13:00 PM", None, None, None),
    ("    :  :     :  :  ", None, None, None),
    ("0", None, None, None),
    ("-5", None, None, None),
    ("", None, None, None),
    (None, "+01:00", "Europe/Berlin", None),
    ("9" * 5000, None, None, None),
]


def test_texts(spark):
    df = spark.createDataFrame([(i, *c[:3], "kept") for i, c in enumerate(CASES)], "id int, capture_date string, offset_time string, time_zone string, spans string")
    got = {r.id: (r.instant_us, r.spans) for r in text_instants(df, "capture_date", "offset_time", "time_zone").collect()}
    for i, c in enumerate(CASES):
        assert got[i] == (c[3], "kept"), c


def test_results_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([c[:3] for c in CASES[:24]], "capture_date string, offset_time string, time_zone string")
    spark.conf.set("spark.sql.session.timeZone", "America/Denver")
    try:
        got = [r.instant_us for r in text_instants(df, "capture_date", "offset_time", "time_zone").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert sorted(got) == sorted(c[3] for c in CASES[:24])


def test_every_zone_against_python(spark):
    texts = [f"{y}:{m:02}:{d:02} {h:02}:{mi:02}:00" for y, m, d in ((2013, 3, 10), (2014, 11, 2), (2016, 3, 27), (2018, 10, 28), (2021, 7, 1), (2024, 4, 7)) for h, mi in ((0, 30), (1, 30), (2, 30), (3, 15))]
    zones = ["Europe/Berlin", "America/New_York", "America/St_Johns", "Australia/Lord_Howe", "Asia/Kathmandu", "Pacific/Auckland", "Europe/Lisbon", "Africa/Casablanca", "America/Sao_Paulo", "Etc/UTC"]
    df = spark.createDataFrame([(t, None, z) for t in texts for z in zones], "capture_date string, offset_time string, time_zone string")
    for r in text_instants(df, "capture_date", "offset_time", "time_zone").collect():
        local = datetime.strptime(r.capture_date, "%Y:%m:%d %H:%M:%S").replace(tzinfo=ZoneInfo(r.time_zone))
        # Python's first reading of a repeated hour is the earlier one; of a skipped hour it takes the offset before the change
        assert r.instant_us == int(local.timestamp()) * 1_000_000, (r.capture_date, r.time_zone)


def test_numbers(spark):
    want = 1_330_354_184
    values = [want, want + 2_082_844_800, want * 1_000, want * 1_000_000, want * 10**9, (want - 978_307_200) * 1_000, (want + 11_644_473_600) * 10**7, 20120227144944, 20120227144944000, None, 0, -1, 5, 20121340000000, 2**62]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v bigint")
    got = [r.us for r in df.select("i", number_us("v").alias("us")).orderBy("i").collect()]
    assert got == [want * 1_000_000] * 9 + [None] * 6


def test_offsets(spark):
    texts = ["+05:30", "-0330", "Z", "UTC+2", "+14:00", "+19:00", "+01:75", " : ", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.o for r in df.select("i", offset_seconds(F.col("t")).alias("o")).orderBy("i").collect()] == [19_800, -12_600, 0, 7_200, 50_400, None, None, None, None, None]


def test_query_has_a_row_an_image(spark):
    got = found(spark, "/root/testdata/sf0.001")
    assert got.columns == ["field_name", "image_id", "instant_us"]
    assert got.count() == got.select("field_name", "image_id").distinct().count() > 900


def test_zone_intervals_agree_with_the_zone_database():
    rng, by = random.Random(1), {}
    for zone, begin, until, offset in zone_intervals():
        by.setdefault(zone, []).append((begin - offset, until - offset, offset))
    names = sorted(available_timezones())
    for _ in range(3_000):
        name, second = rng.choice(names), rng.randrange(0, 2_145_916_800)
        want = (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=second)).astimezone(ZoneInfo(name)).utcoffset().total_seconds()
        assert [o for a, b, o in by[name.lower()] if a <= second < b] == [want], (name, second)


def test_status_tells_how_an_instant_came_about(spark):
    cases = [
        ("2019:10:27 02:30:00", None, "Europe/Berlin", "ambiguous"), ("2019:03:31 02:30:00", None, "Europe/Berlin", "nonexistent"), ("2019:06:01 02:30:00", None, "Europe/Berlin", "zone"),
        ("2019:06:01 02:30:00+02:00", None, "Asia/Tokyo", "offset"), ("2019:06:01 02:30:00", "+01:00", "Asia/Tokyo", "offset"), ("2019:06:01 02:30:00", None, "nowhere", "utc"), ("1326277725", None, None, "number"), ("soon", None, None, "unreadable"), (None, None, "Asia/Tokyo", "unreadable"),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, t string, o string, z string")
    got = {r.i: r.status for r in text_instants(df, "t", "o", "z", status="status").collect()}
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]
