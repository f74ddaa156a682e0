"""Timelines, filters and counts on small catalogues with exact answers."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lumatable.operators import ranges, tags, timeline
from lumatable.plans.catalog import shot_key
from lumatable.plans.filters import SmartQuery, Tables, View

SCHEMA = "id bigint, filename string, created_at bigint, imported_at bigint, format string, group_hash string, rating int, flagged int, color_label int, hidden boolean, missing boolean, width int, height int, orientation int, edited boolean, has_xcf boolean, camera_make string, camera_model string, lens_model string, title string, description string"


def catalog(spark, *files):
    base = dict.fromkeys([c.split()[0] for c in SCHEMA.split(", ")])
    base |= {"imported_at": 0, "format": "JPEG", "hidden": False, "missing": False, "edited": False, "has_xcf": False, "width": 6000, "height": 4000, "orientation": 1, "filename": "x.jpg"}
    df = spark.createDataFrame([tuple((base | f).values()) for f in files], SCHEMA)
    day = F.to_date(F.timestamp_seconds("created_at"))
    return df.withColumns({"shot_key": shot_key(), "year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day)})


def ids(df):
    return [r.id for r in df.collect()]


def test_order_and_aspect(spark):
    c = catalog(spark, {"id": 1, "created_at": 1_600_000_000}, {"id": 2, "created_at": 1_700_000_000}, {"id": 3, "created_at": 1_700_000_100, "orientation": 6})
    out = timeline.in_order(timeline.collapse(View().apply(c))).collect()
    assert [r.id for r in out] == [3, 2, 1] and abs(out[0].aspect - 2 / 3) < 1e-9
    assert ids(View("day", (2020, 9, 13)).apply(c)) == [1]


def test_collapse_of_a_listing(spark):
    c = catalog(spark, {"id": 105, "created_at": 40, "group_hash": "b9", "format": "RAW_CR3"}, {"id": 113, "created_at": 30, "group_hash": "b9"}, {"id": 7, "created_at": 20}, {"id": 9, "created_at": 10, "group_hash": "c0", "format": "RAW_NEF"})
    got = [(r.id, r.versions, r.has_raw_version) for r in timeline.in_order(timeline.collapse(c)).collect()]
    assert got == [(113, 2, True), (7, 1, False), (9, 1, False)]


def test_collapse_with_nulls_two_raws_and_a_filtered_raw(spark):
    c = catalog(spark, {"id": 1, "imported_at": 50, "group_hash": "a", "format": "RAW_NEF", "edited": True}, {"id": 2, "imported_at": 60, "group_hash": "a", "format": "RAW_DNG"}, {"id": 3, "created_at": 55, "rating": 5, "group_hash": "b"}, {"id": 4, "created_at": 55, "rating": 1, "group_hash": "b", "format": "RAW_NEF"})
    got = [(r.id, r.versions, r.has_raw_version, r.is_edited) for r in timeline.in_order(timeline.collapse(c)).collect()]
    assert got == [(2, 2, False, True), (3, 2, True, False)]
    assert [(r.id, r.versions, r.has_raw_version) for r in timeline.collapse(View(rating=3).apply(c)).collect()] == [(3, 1, False)]


def test_calendar(spark):
    c = catalog(spark, {"id": 1, "created_at": 1_600_000_000}, {"id": 2, "created_at": 1_600_000_100}, {"id": 3, "created_at": 1_700_000_000}, {"id": 4})
    assert rows(timeline.date_tree(c)) == [(2020, 9, 13, 2), (2023, 11, 14, 1)]
    assert rows(timeline.sidebar_totals(c)) == [(2020, 9, 2), (2020, None, 2), (2023, 11, 1), (2023, None, 1)]
    assert rows(timeline.covers(c, ["year"])) == [(2020, 2, 1), (2023, 1, 3)]
    assert rows(timeline.sections(timeline.collapse(c))) == [(0, 1), (18518, 2), (19675, 1)]


def test_marks_and_prefixed_search(spark):
    c = catalog(spark, {"id": 1, "rating": 4, "flagged": 1, "camera_model": "Corvane X20"}, {"id": 2, "rating": 2, "flagged": -1, "title": "Café at f/2.8"}, {"id": 3, "color_label": 3, "filename": "IMG_0001.CR3"})
    t = Tables(spark.createDataFrame([(1, "landscape", None), (2, "sunset", 1)], "id bigint, name string, parent_id bigint"), spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "image_id bigint, tag_id bigint"))
    find = lambda x: sorted(ids(View("search", x).apply(c, t)))
    assert sorted(ids(View(rating=3).apply(c))) == [1] and ids(View(rating=0).apply(c)) == [3]
    assert find("is:pick") == [1] and find("is:rejected") == [2] and find("is:other") == [3]
    assert find("label:green") == [3] and find("color:pink") == [1, 2]
    assert find("tag:sun") == [1] and find("tag:land") == [1, 2] and find("camera:corv") == [1]
    assert find("cafe") == [2] and find("f/2") == [2] and find("0001") == [3] and find("img 0001") == [3] and find("cafe 0001") == []
    assert find("landscape") == [1, 2] and find("f/2.8 \"(") == [2]
    assert sorted(ids(View("tag", "Any|landscape").apply(c, t))) == [1, 2] and ids(View("tag", "sunset").apply(c, t)) == [1]


def test_saved_queries(spark):
    c = catalog(spark, {"id": 1, "rating": 5}, {"id": 2, "rating": 4}, {"id": 3, "rating": 4, "flagged": -1}, {"id": 4, "rating": 5, "hidden": True})
    t = Tables(spark.createDataFrame([(1, "Nature", None), (2, "client-x", None)], "id bigint, name string, parent_id bigint"), spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 1)], "image_id bigint, tag_id bigint"))
    q = SmartQuery.parse('{"min_rating": 4, "tags": ["nature"], "exclude_rejected": true, "new_key": 1}')
    assert sorted(ids(q.apply(c, t))) == [1, 2] and q.describe() == "≥ 4 stars · not rejected · nature"
    assert ids(SmartQuery(tags=["nature"], not_tags=["client-x"], exclude_rejected=True).apply(c, t)) == [1]
    with pytest.raises(ValueError):
        SmartQuery.parse("[1")


def test_tag_counts_add_up_over_the_tree(spark):
    c = catalog(spark, {"id": 1, "group_hash": "s"}, {"id": 2, "group_hash": "s"}, {"id": 3, "group_hash": "t"})
    tg = spark.createDataFrame([(1, "Places", None), (2, "Europe", 1), (3, "Paris", 2)], "id bigint, name string, parent_id bigint")
    it = lambda *p: spark.createDataFrame(list(p), "image_id bigint, tag_id bigint")
    assert rows(tags.tree_counts(tg, it((1, 3), (2, 3)), c)) == [(1, 0, 1), (2, 0, 1), (3, 1, 1)]
    assert rows(tags.tree_counts(tg, it((1, 3), (2, 3), (3, 3), (1, 1)), c)) == [(1, 1, 3), (2, 0, 2), (3, 2, 2)]
    assert rows(tags.expand_shots(spark.createDataFrame([(1,)], "id bigint"), c)) == [(1,), (2,)]


def test_named_ranges(spark):
    c = catalog(spark, {"id": 1, "created_at": 1_700_000_000}, {"id": 2, "created_at": 1_700_086_400})
    r = spark.createDataFrame([(1, "Conference", 1_699_999_000, 1_700_050_000), (2, "Wide", 0, 2_000_000_000), (3, "None", 5, 6)], "range_id bigint, name string, start_date bigint, end_date bigint")
    assert [(x.range_id, x.n_files) for x in ranges.with_counts(c, r).orderBy("range_id").collect()] == [(1, 1), (2, 2), (3, 0)]
    assert rows(ranges.narrowest(c, r)) == [(1, 1), (2, 2)]
    day = 1_700_006_400  # 2023-11-15
    named = ranges.name_day(r.where("range_id = 3"), "Fair", day)
    assert rows(named.select("name", "start_date", "end_date")) == [("Fair", day, day + 86_399), ("None", 5, 6)]
    assert [x.name for x in ranges.name_day(r.where("range_id = 2"), "Fair", day).collect()] == ["Fair"]


def test_versions_rows_and_eviction(spark):
    c = catalog(spark, {"id": 1, "group_hash": "g", "format": "RAW_ORF"}, {"id": 2, "group_hash": "g"}, {"id": 3, "group_hash": "g"}, {"id": 4})
    pick = lambda mode, sel: sorted(ids(timeline.pick_versions(c.withColumn("selected", F.col("id").isin(sel)), mode)))
    assert pick("all", [2]) == [1, 2, 3] and pick("raw", [2]) == [1] and pick("raster", [2]) == [2, 3] and pick("raw", [4]) == [4]
    packed = timeline.justify(timeline.collapse(catalog(spark, *({"id": i, "created_at": 100 + i} for i in range(5)))), 700, 200)
    assert sorted((r.row, r.id) for r in packed.collect()) == [(0, 2), (0, 3), (0, 4), (1, 0), (1, 1)]
    files = spark.createDataFrame([("a", 10, 100), ("b", 20, 200), ("c", 30, 90_000)], "path string, bytes bigint, s bigint").select("path", "bytes", F.timestamp_seconds("s").alias("accessed"))
    assert [r.path for r in timeline.evict(files, 35).orderBy("path").collect()] == ["a", "b"] and timeline.evict(files, 60).count() == 0
    assert timeline.rail_marks([(0, 1), (1, 5), (10, 2)], 3) == [1, 10]
