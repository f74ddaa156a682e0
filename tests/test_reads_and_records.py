"""Reads and small tables on rows with known answers, with nulls, ties, repeats and empty tables."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lumatable.functions import scalars as S
from lumatable.operators import quality, reads, records, sidecars
from lumatable.plans import backup, core_queries, read_queries
from lumatable.plans import catalog as C
from lumatable.plans.filters import SmartQuery, Tables, View

IMG = "id bigint, path string, filename string, format string, shot_key string, created_at bigint, imported_at bigint, rating int, flagged int, hidden boolean, title string"


@pytest.fixture(scope="module")
def images(spark):
    data = [
        (1, "/a/x.jpg", "x.jpg", "JPEG", "g", 100, 5, 5, 1, False, "Red boat"), (2, "/a/x.orf", "x.orf", "RAW_ORF", "g", 100, 5, 0, 0, False, None), (3, "/b/y.jpg", "y.jpg", None, "id:3", None, 300, None, None, None, "boat, Boats"),
        (4, "/b/z.jpg", "z.jpg", "JPEG", "id:4", 50, 1, 3, -1, True, "Über boat"), (5, None, None, None, "id:5", None, None, None, None, None, ""),
    ]
    return spark.createDataFrame(data, IMG).withColumns({c: F.lit(None).cast("string") for c in ("camera_make", "camera_model", "lens_model", "description")})


def ids(df):
    return [r.id for r in df.collect()]


def test_pages_and_points(images):
    assert ids(reads.page(images, 2)) == [3, 2] and ids(reads.page(images, 9, 3)) == [4, 5]
    assert ids(reads.by_id(images, 4)) == [4] and ids(reads.by_id(images, 99)) == [] and ids(reads.id_of_path(images, "/b/y.jpg")) == [3]
    assert ids(reads.group_listing(images.withColumn("group_hash", F.lit("q")), "q")) == [5, 3, 1, 4, 2]


def test_shots_of_a_selection(spark, images):
    chosen = spark.createDataFrame([(3, 0), (2, 1), (1, 2), (2, 3), (77, 4)], "id bigint, place int")
    got = [(r.shot_key, r.versions, r.selected) for r in reads.shots_of(chosen, images).collect()]
    assert got == [("id:3", [3], [3]), ("g", [1, 2], [1, 2])]
    assert reads.distinct_shots(chosen, images).first()[0] == 2 and reads.shots_of(chosen.limit(0), images).count() == 0


def test_trash_keeps_other_versions(spark, images):
    one = lambda i: spark.createDataFrame([(i,)], "id bigint")
    assert rows(reads.trash_plan(images, one(1), "raw").select("id", "trashed")) == [(1, False), (2, True)]
    assert rows(reads.trash_plan(images, one(3), "raw").select("id", "trashed")) == [(3, True)]


def test_ranked_search(spark, images):
    images = images.unionByName(spark.range(100, 130).select(*(F.col("id") if c == "id" else F.lit("other words" if c == "title" else None).cast(t).alias(c) for c, t in images.dtypes)))
    got = [(r.id, r.score) for r in reads.ranked_search(images, "BOAT", 10).collect()]
    assert [i for i, _ in got][0] == 3 and {i for i, _ in got} == {1, 3, 4} and got == sorted(got, key=lambda x: (-x[1], -x[0]))
    assert reads.ranked_search(images, "uber", 10).count() == 1 and reads.ranked_search(images, " - ", 10).count() == 0 and reads.ranked_search(images.limit(0), "boat", 10).count() == 0
    assert sorted(ids(reads.library_search(images, "boat"))) == [1, 3, 4]


def test_lists(spark):
    seen = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("a", 0)], "k string, at int")
    assert [r.k for r in reads.first_seen(seen, "k", "at").collect()] == ["a", "b"]
    texts = spark.createDataFrame([("[1, 2]",), ("oops",), (None,), ("[null, 7]",)], "j string")
    assert ids(reads.ids_of_json(texts, "j").orderBy("id")) == [1, 2, 7]
    assert [r.name for r in reads.by_name(spark.createDataFrame([("b",), ("A",), ("a",)], "name string")).collect()] == ["A", "a", "b"]


def test_tops_of_rows(spark):
    made = spark.createDataFrame([(2, 0, 10.0), (2, 1, 20.0), (1, 0, 5.0), (None, 0, 7.0)], "day_number bigint, row int, height double")
    assert rows(reads.row_tops(made, 3.0)) == sorted([(2, 0, 0, 3.0), (2, 1, 0, 13.0), (1, 0, 0, 36.0), (None, 0, 0, 44.0)], key=repr)


def test_tag_paths_with_a_cycle(spark):
    tags = spark.createDataFrame([(1, "Places", None), (2, "Paris", 1), (3, "a", 4), (4, "b", 3), (5, None, 2)], "id bigint, name string, parent_id bigint")
    assert dict(rows(reads.tag_paths(tags))) == {1: "Places", 2: "Places|Paris", 3: "a", 4: "b", 5: "Places|Paris|"}


def test_small_tables(spark):
    t = spark.createDataFrame([(3, "b", None), (7, "A", "x")], "id bigint, name string, note string")
    more = records.create(t, name="c")
    assert rows(more)[-1] == (8, "c", None) and rows(records.create(t.limit(0), name="first")) == [(1, "first", None)]
    assert rows(records.update(t, 3, note="n"))[0] == (3, "b", "n") and ids(records.delete(t, 3)) == [7] and ids(records.get(t, 7)) == [7] and ids(records.in_name_order(t)) == [7, 3]
    log = spark.createDataFrame([], "id bigint, source string, started_at bigint, finished_at bigint, imported bigint, duplicates bigint, errors bigint, status string")
    log = records.start_import(records.start_import(log, "/card", 10), "/disk", 11)
    assert records.running_imports(log).count() == 2
    done = records.finish_import(records.finish_import(log, 1, 20, 0, 0, 3), 2, 21, 5, 1, 1)
    assert [r.status for r in done.orderBy("id").collect()] == ["failed", "complete"]
    edits_log = spark.createDataFrame([], "id bigint, image_id bigint, tool_name string, sidecar_path string, edited_at bigint")
    edits_log = records.record_edit(records.record_edit(edits_log, 5, "one", 10), 5, "two", 10, "/s")
    assert [r.tool_name for r in records.edit_history(edits_log, 5).collect()] == ["two", "one"]
    assert rows(records.save_preset(records.save_preset(spark.createDataFrame([], "name string, value string"), "p", "1"), "p", "2")) == [("p", "2")]
    changes = spark.createDataFrame([(i, "x") for i in range(60)], "at bigint, kind string")
    assert records.keep_newest(changes).agg(F.min("at"), F.count("at")).first() == (10, 50)
    with pytest.raises(ValueError):
        records.create_tag(t, " | ")


def test_album_covers_are_repaired(spark):
    albums = spark.createDataFrame([(1, 10), (2, None)], "album_id bigint, cover_image_id bigint")
    members = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], "album_id bigint, image_id bigint, position bigint")
    one = lambda i: spark.createDataFrame([(i,)], "id bigint")
    after, left = records.remove_from_album(albums, members, 1, one(10))
    assert rows(after) == [(1, 11), (2, None)] and left.count() == 1
    assert rows(records.add_to_album(albums, members, 2, one(7))[0]) == [(1, 10), (2, 7)]


def test_saved_queries_that_cannot_be_read_count_nothing(spark, images):
    saved = spark.createDataFrame([(1, json.dumps({"min_rating": 3})), (2, "{"), (3, "[]"), (4, json.dumps({"text": "boat"}))], "id bigint, query_json string")
    none = Tables(tags=spark.createDataFrame([], "id bigint, name string, parent_id bigint"), image_tags=spark.createDataFrame([], "image_id bigint, tag_id bigint"))
    assert dict(rows(records.counts_of_saved(saved, images.withColumn("color_label", F.lit(0)), none))) == {1: 1, 2: 0, 3: 0, 4: 2}
    assert records.counts_of_saved(saved.limit(0), images, none).count() == 0


def test_display_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert [one(S.format_bytes(F.lit(n))) for n in (0, 1_023, 1_024, 1_280, 5_000_000, None)] == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "4.8 MB", None]
    assert [one(S.describe_shift(F.lit(n))) for n in (0, -3_661, 90_061)] == ["+00:00:00", "-01:01:01", "+1d 01:01:01"]
    assert one(S.section_title(F.lit(0), F.lit(2))) == "Thursday, January 1, 1970  ·  2 photos"
    assert [one(S.parse_wall_clock(F.lit(t))) for t in ("1970-01-02 00:00:01", " 1970-01-01 00:01 ", "x", None)] == [86_401, 60, None, None]
    assert tuple(one(S.day_bounds(F.lit(1970), F.lit(1), F.lit(2)))) == (86_400, 172_799) and tuple(one(S.day_bounds(F.lit(2021), F.lit(2), F.lit(29)))) == (0, 0)
    assert one(S.step_index(F.lit(1), F.lit(-3), F.lit(4))) == 2 and one(S.step_index(F.lit(1), F.lit(1), F.lit(0))) is None
    assert one(S.capture_moment(original=F.lit(None).cast("bigint"), container=F.lit(0), mtime=F.lit(9))) == 9
    assert [one(S.mime_of_content(F.lit(bytearray(b)))) for b in (b"\xff\xd8\xff\xe0", b"RIFF0000WEBPVP8 ", b"....ftypqt  ", b"hello", b"")] == ["image/jpeg", "image/webp", "video/quicktime", None, None]


def test_sidecar_places_and_stale_ones(spark):
    place = lambda a, b, c: spark.range(1).select(sidecars.sidecar_destination(*map(F.lit, (a, b, c))).alias("v")).first().v
    assert place("/c/a.orf", "/c/a.orf.xmp", "/l/b.orf") == "/l/b.orf.xmp" and place("/c/a.orf", "/c/a.xmp", "/l/b.orf") == "/l/b.xmp"
    images = spark.createDataFrame([(1, "/a/x.jpg", 5, False), (2, "/a/y.jpg", None, False), (3, "/a/z.jpg", 9, True)], "id bigint, path string, xmp_mtime bigint, has_sidecar boolean")
    files = spark.createDataFrame([("/a/x.jpg.xmp", 6), ("/a/x.xmp", 1), ("/a/y.xmp", 1), ("/a/z.jpg.xmp", 9), ("/a/X.XCF", 1)], "path string, mtime bigint")
    assert rows(sidecars.stale(images, files)) == [(1, "/a/x.jpg.xmp", 6), (2, "/a/y.xmp", 1)]
    written = sidecars.after_write(images, spark.createDataFrame([(2, 30)], "id bigint, mtime bigint"))
    assert rows(written.select("id", "xmp_mtime", "has_sidecar"))[1] == (2, 30, True)
    assert rows(sidecars.find_project(images, files)) == [(1, "/a/X.XCF")]


def test_editor_keywords_leave_the_tags(spark):
    tags = spark.createDataFrame([(1, "darktable", None), (2, "format", None), (3, "sea", None), (4, "orf", None)], "id bigint, name string, parent_id bigint")
    used = spark.createDataFrame([(9, 1), (9, 2), (9, 3), (9, 4), (8, 4)], "image_id bigint, tag_id bigint")
    docs = spark.createDataFrame([(9, ["darktable|format|orf", "Art|format"]), (8, ["darktable|orf"]), (7, None)], "image_id bigint, paths array<string>")
    left, still = sidecars.repair_keyword_tags(tags, used, docs)
    assert rows(still) == [(8, 4), (9, 2), (9, 3)] and ids(left.orderBy("id")) == [2, 3, 4]
    again = sidecars.repair_keyword_tags(left, still, docs)
    assert rows(again[1]) == rows(still)


def test_choices_and_reviews(spark):
    one = lambda *i: spark.createDataFrame([(x,) for x in i], "id bigint")
    assert ids(quality.final_rejects(one(1, 2, 3), one(2), one(3, 9, 9))) == [1, 3, 9]
    images = spark.createDataFrame([(1, -1), (2, 0), (3, None)], "id bigint, flagged int")
    assert rows(quality.apply_choices(images, one(2, 3), one(1, 3))) == [(1, 0), (2, -1), (3, -1)]
    files = spark.createDataFrame([(1, 100, "c", "a", 0), (2, 900, "c", "b", 0)], "id bigint, created_at bigint, camera string, shot_key string, flagged int")
    scores = spark.createDataFrame([(1, 2.0, 2.0, 0.0, 0.0, 9.0, 2), (2, 300.0, 2.0, 0.0, 0.9, 9.0, 2)], "id bigint, sharpness double, sharpness_global double, clip_shadows double, clip_highlights double, mean_luma double, quality_version int")
    none = spark.createDataFrame([], "median_sharpness double, eye_p80 double, weak_below double")
    assert rows(quality.review_rejects(files, scores, none)) == [(1, "blurred"), (2, "highlights")]
    suggested = quality.suggestions(files, quality.new_rows(scores, 7).withColumn("has_crop", F.lit(False)), none)
    assert quality.reject_count(suggested).first()[0] == 2
    reading = quality.session_readings(files, quality.new_rows(scores, 7), none, suggested)
    assert rows(reading.select("id", "percent", "grade")) == [(1, 5.0, "Bad"), (2, 5.0, "Bad")]


def test_snapshots_are_checked_rotated_and_restored(spark, tmp_path):
    folder, other = str(tmp_path / "b"), str(tmp_path / "m")
    one = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, name string")
    assert backup.is_due(spark, folder, 0) and backup.snapshots(spark, folder).count() == 0
    for at in (100, 200, 300):
        backup.snapshot({"t": one.where(f"id * 150 <= {at}"), "empty": one.limit(0)}, folder, at)
    one.write.parquet(f"{folder}/snapshot-400/t")  # not finished
    assert backup.rotate(spark, folder, keep=2) == [100] and not backup.is_due(spark, folder, 300 + backup.EVERY_S - 1) and backup.is_due(spark, folder, 300 + backup.EVERY_S)
    back = backup.restore(spark, folder)
    assert rows(back["t"]) == [(1, "a"), (2, None)] and back["empty"].count() == 0 and rows(backup.restore(spark, folder, 200)["t"]) == [(1, "a")]
    assert backup.mirror(spark, folder, other) == [200, 300] and backup.mirror(spark, folder, other) == []
    with pytest.raises(FileNotFoundError):
        backup.restore(spark, folder, 400)


DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("view, pushed", [(View(rating=3, flag=1), ["rating", "flagged", "hidden"]), (View("color", 2), ["color_label"]), (View("missing"), ["missing"]), (View("smart", 1), ["hidden"])])
def test_filters_reach_the_scan(spark, view, pushed):
    df = core_queries.tiles(view)(spark, DATA)
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    filters = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert all(c in filters for c in pushed), filters


def test_only_the_columns_asked_for_are_read(spark):
    df = read_queries.QUERIES["date_tree"](spark, DATA)
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    schema = next(line for line in plan.splitlines() if "ReadSchema" in line)
    assert "metadata_json" not in schema and "path" not in schema and "created_at" in schema


def test_years_are_a_parameter(spark):
    late = spark.createDataFrame([(1, 1_800_000_000)], "id bigint, created_at bigint")
    from lumatable.functions.instants import number_us

    assert late.select(number_us("created_at")).first()[0] is None
    assert late.select(number_us("created_at", (1_325_376_000, 1_900_000_000))).first()[0] == 1_800_000_000_000_000
    assert C.images(spark, DATA).count() > 0 and SmartQuery.parse("{}").describe() == ""
