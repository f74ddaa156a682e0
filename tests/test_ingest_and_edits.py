"""Import, sidecars, edits, kernels, scalars, sources and the import stream on small cases with exact answers."""

import sqlite3
import threading

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lumatable.functions import scalars as S
from lumatable.operators import arrays, edits, ingest, sidecars
from lumatable.runtime import cancellable
from lumatable.sources.files import DigikamSource, FolderSource, ListSource, ShotwellSource
from lumatable.streaming import ingest as stream


def one(spark, **values):
    """A one-row frame of literals."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))


def val(spark, column, **values):
    return one(spark, **values).select(column.alias("v")).first().v


def test_scalars(spark):
    v = lambda c, **k: val(spark, c, **k)
    assert v(S.base_stem(F.col("n")), n="/p/IMG_1_edit.JPG") == "IMG_1" and v(S.base_stem(F.col("n")), n="IMG_1_EDIT.JPG") == "IMG_1_EDIT"
    assert v(S.format_of(F.col("n")), n="a.HEIC") == "HEIF" and v(S.format_of(F.col("n")), n="a.pef") == "UNKNOWN" and v(S.is_raw(F.col("n")), n="cr3")
    assert [v(S.format_exposure(F.lit(x))) for x in (0.004, 2.0)] == ["1/250", "2"]
    assert [v(S.format_duration(F.lit(x))) for x in (42.3, 65, 3665)] == ["0:42", "1:05", "1:01:05"]
    assert v(S.duration_of_metadata(F.col("m")), m='{"duration_seconds": 3700}') == "61:40" and v(S.duration_of_metadata(F.col("m")), m="{broken") is None
    assert [v(S.rotate(F.lit(o), cw)) for cw in (True, False) for o in (1, 8, 0, 99)] == [6, 1, 6, 6, 8, 3, 8, 8]
    for cw in (True, False):
        turned = F.col("o")
        for _ in range(4):
            turned = S.rotate(turned, cw)
        assert spark.range(1, 9).select(F.col("id").cast("int").alias("o")).where(turned != F.col("o")).count() == 0
    assert v(S.filename_from_template("{date:%Y%m%d}_{name}.{ext}", F.lit("IMG_001"), F.lit(1_718_452_800), F.lit("JPEG"))) == "20240615_IMG_001.JPEG"
    assert v(S.filename_from_template("{name}-{date}", F.lit("a"), F.lit(None).cast("bigint"), F.lit("jpg"))) == "a-.jpg"
    assert v(S.percent_decode(F.lit("a%20b+c"))) == "a b+c" and v(S.xml_unescape(S.xml_escape(F.lit("<a & 'b'>")))) == "<a & 'b'>"
    assert abs(v(S.gps_coordinate(F.lit(2), F.lit(15), F.lit(0), F.lit("W"))) + 2.25) < 1e-9 and v(S.gps_coordinate(F.lit(95), F.lit(0), F.lit(0), F.lit("N"))) is None
    assert v(S.color_number(F.lit("Green"))) == 3 and v(S.color_name(F.lit(9))) is None and v(S.darktable_color(F.lit(1))) == 0 and v(S.thumb_path(F.lit("abcd"), "grid")) == "grid/ab/abcd.jpg"
    assert [val(spark, c) for c in S.target_size(F.lit(6000), F.lit(4000), 1200)] == [1200, 800]


def test_scan_and_dedup(spark):
    schema = "id bigint, path string, filename string, original_filename string, size_bytes bigint, created_at bigint, hash string"
    lib = spark.createDataFrame([(1, "/l/IMG_1_1.JPG", "IMG_1_1.JPG", "IMG_1.JPG", 42, 7, "AA")], schema)
    new = spark.createDataFrame([(10, "/c/img_1.jpg", "img_1.jpg", None, 42, 7, "x"), (11, "/c/img_1.jpg", "img_1.jpg", None, 43, 7, "aa"), (12, "/l/IMG_1_1.JPG", "z", None, 1, None, None), (13, "/c/y.jpg", "y.jpg", None, 1, None, "X")], schema)
    assert rows(ingest.pre_scan(new, lib).select("id", "known")) == [(10, True), (11, False), (12, True), (13, False)]
    assert rows(ingest.new_by_hash(new, lib).select("id")) == [(10,), (12,)]
    out, counts = ingest.insert_new(lib, new)
    assert out.count() == 3 and tuple(counts.first()) == (2, 2)
    files = spark.createDataFrame([(p,) for p in ("/p/IMG_001.ORF", "/p/IMG_001.JPG", "/p/IMG_001_modified.jpg", "/p/IMG_002.JPG", "/q/IMG_001.JPG")], "path string")
    got = dict(rows(ingest.group_map(files)))
    assert len({got[p] for p in list(got) if p.startswith("/p/IMG_001")}) == 1 and len(got["/p/IMG_001.ORF"]) == 16 and got["/p/IMG_002.JPG"] is None is got["/q/IMG_001.JPG"]


def test_destinations_relink_and_check(spark):
    files = spark.createDataFrame([(1, "IMG_1.jpg", 1_688_463_000), (2, "IMG_1.jpg", 1_688_463_000), (3, "IMG_2.jpg", None), (4, "IMG_1_1.jpg", 1_688_463_000)], "id bigint, filename string, created_at bigint")
    taken = spark.createDataFrame([("Unsorted/IMG_2.jpg",)], "destination string")
    got = dict(rows(ingest.plan_destinations(files, taken)))
    assert got[1] == "2023/07/04/IMG_1.jpg" and got[4] == "2023/07/04/IMG_1_1.jpg" and got[2] == "2023/07/04/IMG_1_2.jpg" and got[3] == "Unsorted/IMG_2_1.jpg"
    missing = spark.createDataFrame([(1, "a.jpg", 5, "h"), (2, "A.jpg", 5, "h"), (3, "b.jpg", 5, "h")], "id bigint, filename string, size_bytes bigint, hash string")
    there = spark.createDataFrame([("/n/A.JPG", 5, "h"), ("/n/b.jpg", 6, "h")], "path string, size_bytes bigint, hash string")
    assert rows(ingest.relink(missing, there)) == [(1, "/n/A.JPG")]
    imgs = spark.createDataFrame([("/a", False), ("/b", True), ("/c", False)], "path string, missing boolean")
    assert rows(ingest.library_check(imgs, spark.createDataFrame([("/b",), ("/c",), ("/d",)], "path string"))) == [("/a", "missing"), ("/b", "found"), ("/d", "new")]


def test_many_files_of_one_name_all_get_a_place(spark):
    """Against one by one numbering, real names first."""
    names = ["I.jpg"] * 130 + ["I_3.jpg", "I_4.jpg", "I_4.jpg", "I_07.jpg", "I_120.jpg", "J", "J", "J_1", "a.b.c", "a.b.c", ".x", ".x", "K.jpg"]
    files = [(1_000 - 7 * i, n, None) for i, n in enumerate(names)] + [(1_000, "I.jpg", None), (1_000, "I.jpg", None), (None, "I.jpg", None), (5_000, None, None)]
    used = ["Unsorted/I.jpg", "Unsorted/I_1.jpg", "Unsorted/I_9.jpg", "Unsorted/I_10.jpg", "Unsorted/I_90000.jpg", "Unsorted/K.jpg", "Unsorted/K_1.jpg", None]
    taken = spark.createDataFrame([(u,) for u in used], "destination string")
    split = lambda n: (n[: n.rindex(".")] or n, n[n.rindex(".") :]) if "." in n else (n, "")
    waiting, full, want, k = {(i, *split(n)) for i, n, _ in files if i is not None and n is not None}, set(used), set(), 0
    while waiting:
        got = {}
        for i, stem, ext in sorted(waiting, reverse=True):
            got[f"Unsorted/{stem}{f'_{k}' if k else ''}{ext}"] = (i, stem, ext)
        got = {d: w for d, w in got.items() if d not in full}
        want |= {(w[0], d) for d, w in got.items()}
        waiting, full, k = waiting - set(got.values()), full | set(got), k + 1
    many = spark.createDataFrame(files, "id bigint, filename string, created_at bigint")
    for part_rows in (100_000, 7):
        got = rows(ingest.plan_destinations(many, taken, part_rows=part_rows))
        assert got == sorted(want, key=repr) and len({d for _, d in got}) == len(got) == len(names)


XMP = """<?xpacket begin="" id="x"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF><rdf:Description xmp:Rating="{r}" xmp:Label="Green" tiff:Orientation="6">
<dc:title><rdf:Alt><rdf:li xml:lang="x-default">My Title</rdf:li></rdf:Alt></dc:title><dc:subject><rdf:Bag>{s}</rdf:Bag></dc:subject>
<lr:hierarchicalSubject><rdf:Bag>{h}</rdf:Bag></lr:hierarchicalSubject></rdf:Description></rdf:RDF></x:xmpmeta> trailing words"""
LI = lambda *x: "".join(f"<rdf:li>{i}</rdf:li>" for i in x)


def test_sidecars(spark):
    docs = [(1, XMP.format(r=4, s=LI("darktable", "format", "orf", "changed", "wedding", "places"), h=LI("darktable|format|orf", "darktable|changed", "places|format"))), (2, XMP.format(r=-1, s="", h="")), (3, XMP.format(r=9, s=LI("a"), h="")), (4, "<broken"), (5, None), (6, "")]
    got = {r.doc_id: r for r in sidecars.read_sidecars(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert (got[1].rating, got[1].rejected, got[1].title, got[1].color_label, got[1].orientation) == (4, False, "My Title", 3, 6)
    assert got[1].tags == ["format", "wedding", "places"] and got[1].hierarchical_tags == ["places|format"]
    assert (got[2].rating, got[2].rejected) == (None, True) and (got[3].rating, got[3].rejected) == (None, None)
    assert [got[i].readable for i in (4, 5, 6)] == [False] * 3
    imgs = spark.createDataFrame([(1, 4, 0, None, None, 1, 0, None), (2, 4, -1, "t", None, 1, 2, 10), (3, 1, 1, None, None, 1, 0, 50)], "id bigint, rating int, flagged int, title string, description string, orientation int, color_label int, xmp_mtime bigint")
    read = spark.createDataFrame([(1, None, True, None, None, None, None, 5), (2, 2, False, None, "d", None, None, 11), (3, 5, False, None, None, None, None, 50)], "id bigint, rating int, rejected boolean, title string, description string, orientation int, color_label int, mtime bigint")
    assert rows(sidecars.update_from_sidecars(imgs, read).select("id", "rating", "flagged", "title", "description")) == [(1, 4, -1, None, None), (2, 2, 0, "t", "d"), (3, 1, 1, None, None)]
    shots = spark.createDataFrame([(1, "s", "s", 5, 0, 0), (2, "s", "s", 0, -1, 3), (3, "t", "t", 1, 1, 3), (4, "t", "t", 1, -1, 4)], "id bigint, group_hash string, shot_key string, rating int, flagged int, color_label int")
    agreed = sidecars.reconcile_shots(shots)
    assert rows(agreed) == [(1, 5, -1, 3), (2, 5, -1, 3), (3, 1, 1, 3), (4, 1, -1, 4)]
    said = spark.createDataFrame([(2, 2, None, 5)], "id bigint, rating int, flagged int, color_label int")
    assert rows(sidecars.spread_cull(shots.where("shot_key = 's'"), said)) == [(1, 2, 0, 5), (2, 2, -1, 5)]
    names = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "id bigint, name string")
    tags = spark.createDataFrame([(1, ["a", "c", "P"], ["P|Q"])], "id bigint, tags array<string>, hierarchical_tags array<string>")
    assert rows(sidecars.replace_keywords(names, tags)) == [(1, "Q"), (1, "a"), (1, "c"), (2, "z")]
    files = spark.createDataFrame([("/a/x.jpg.xmp",), ("/a/x.xmp",), ("/a/y.xmp",)], "path string")
    assert rows(sidecars.find_sidecar(spark.createDataFrame([(1, "/a/x.jpg"), (2, "/a/y.nef"), (3, "/a/q.jpg")], "id bigint, path string"), files)) == [(1, "/a/x.jpg.xmp"), (2, "/a/y.xmp")]
    assert val(spark, sidecars.merge_keywords(F.array(F.lit("mine"), F.lit("x")), F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y")))) == ["mine", "y"] and val(spark, sidecars.fill_copyright(F.lit(" "), F.lit("me"))) == "me"


def test_sidecar_queries_read_every_sidecar(spark, tmp_path):
    """Truncated, blank, null and other-rooted documents too, with all fields."""
    from lumatable.plans import core_queries

    whole = XMP.format(r=4, s=LI("a"), h="")
    bare = whole[whole.index("<rdf:RDF") : whole.index("</x:xmpmeta>")]
    docs = [(1, whole, "sidecar", 1), (2, whole[:100], "sidecar", 2), (3, " ", "sidecar", 3), (4, None, "sidecar", 4), (5, bare, "sidecar", 5), (6, whole, "note", 6)]
    spark.createDataFrame(docs, "doc_id bigint, text string, doc_kind string, image_id bigint").write.parquet(f"{tmp_path}/documents.parquet")
    images = spark.read.parquet("/root/testdata/sf0.001/images.parquet").limit(1)
    images = spark.range(1, 7).join(images.drop("id").withColumns({"rating": F.lit(1).cast(images.schema["rating"].dataType), "flagged": F.lit(0).cast(images.schema["flagged"].dataType)}))
    images.write.parquet(f"{tmp_path}/images.parquet")
    got = {r.doc_id: r for r in core_queries.QUERIES["sidecars_read"](spark, str(tmp_path)).collect()}
    assert {i: r.readable for i, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: True}
    assert (got[5].rating, got[5].title, got[5].tags, got[5].orientation, got[5].color_label) == (4, "My Title", ["a"], 6, 3) and got[2].rating is None
    assert rows(core_queries.QUERIES["sidecar_update"](spark, str(tmp_path)).select("id", "rating")) == [(1, 4), (2, 1), (3, 1), (4, 1), (5, 4), (6, 1)]


def test_edits(spark):
    imgs = spark.createDataFrame([(1, 2, 0, "s", 100, 1), (2, 3, 0, "s", None, 6), (3, 1, 1, "t", 50, 1)], "id bigint, rating int, flagged int, shot_key string, created_at bigint, orientation int")
    pick = lambda *i: spark.createDataFrame([(x,) for x in i], "id bigint")
    assert rows(edits.set_for(imgs, pick(1, 9), rating=9).select("id", "rating")) == [(1, 5), (2, 3), (3, 1)]
    assert rows(edits.set_for_shots(imgs, pick(1), flagged=-5).select("id", "flagged")) == [(1, -1), (2, -1), (3, 1)]
    assert rows(edits.shift_time(imgs, pick(2), 60).select("id", "created_at")) == [(1, 160), (2, None), (3, 50)]
    assert rows(edits.rotate(imgs, pick(2)).select("id", "orientation")) == [(1, 1), (2, 3), (3, 1)]
    kept, children = edits.delete_with_children(imgs, {"t": spark.createDataFrame([(1, 5), (3, 5)], "image_id bigint, tag_id bigint")}, pick(3, 999))
    assert kept.count() == 2 and rows(children["t"]) == [(1, 5)]
    assert edits.restore(kept, imgs).count() == 3
    log = edits.log_change(spark.createDataFrame([], "at bigint, kind string, id bigint, before string"), imgs.where("id = 1"), "rate", 7)
    assert rows(edits.undo(edits.set_for(imgs, pick(1), rating=0), log, 7)) == rows(imgs)
    q = "image_id bigint, sharpness double, aesthetic double, aesthetic_crop double"
    old = spark.createDataFrame([(1, 120.5, 5.25, 6.0), (2, 1.0, 2.0, 3.0)], q)
    assert rows(edits.upsert_quality(old, spark.createDataFrame([(1, 9.0, None, None), (2, 8.0, 4.0, None), (3, 7.0, None, None)], q))) == [(1, 9.0, 5.25, 6.0), (2, 8.0, 4.0, None), (3, 7.0, None, None)]
    tags = spark.createDataFrame([(1, "Places", None), (2, "Paris", None)], "id bigint, name string, parent_id bigint")
    assert rows(edits.ensure_tag_path(tags, "places|France|Paris")) == [(1, "Places", None), (2, "Paris", 3), (3, "France", 1)]
    it = spark.createDataFrame([(1, 1)], "image_id bigint, tag_id bigint")
    assert rows(edits.tag_images(it, pick(1, 2), 1)) == [(1, 1), (2, 1)] and edits.untag_images(it, pick(1), spark.createDataFrame([(1,)], "tag_id bigint")).count() == 0
    assert rows(edits.delete_unused_tags(tags, it, ["places", "paris"]).select("id")) == [(1,)]
    album = spark.createDataFrame([(1, 7, 0)], "album_id bigint, image_id bigint, position bigint")
    more = edits.add_to_album(album, 1, pick(7, 9, 8))
    assert rows(more) == [(1, 7, 0), (1, 8, 1), (1, 9, 2)] and rows(edits.album_covers(edits.remove_from_album(more, 1, pick(7)))) == [(1, 8)]
    kv = spark.createDataFrame([("a", "1")], "key string, value string")
    assert rows(edits.put_value(edits.put_value(kv, "a", "2"), "b", "3")) == [("a", "2"), ("b", "3")]
    assert edits.interrupt_running(spark.createDataFrame([("running",), ("done",)], "status string")).where("status = 'interrupted'").count() == 1


def test_kernels(spark):
    w, b = arrays.fold_layers([(np.array([[1.0, 2.0], [0.0, 1.0]]), np.array([1.0, 0.0])), (np.array([[2.0, 1.0]]), np.array([0.5]))])
    assert w == [2.0, 5.0] and b == 2.5
    assert abs(val(spark, arrays.head_score(F.array(F.lit(3.0), F.lit(4.0)), w, b)) - (0.6 * 2 + 0.8 * 5 + 2.5)) < 1e-9 and val(spark, arrays.head_score(F.array().cast("array<double>"), w, b)) is None
    crops = arrays.crop_candidates(spark.createDataFrame([(1, 3000, 2000), (2, 1000, 1000), (3, None, None)], "id bigint, width int, height int"))
    assert rows(crops.groupBy("id").count()) == [(1, 21), (2, 19), (3, 19)]
    assert val(spark, arrays.describe_crop(F.lit(1 / 3), F.lit(0.0), F.lit(2 / 3), F.lit(1.0))) == "a square from the right, keeping 67% of the frame"
    boxes = F.array(*(F.struct(F.lit(s).alias("score"), F.lit(x).alias("x"), F.lit(0.0).alias("y"), F.lit(100.0).alias("w"), F.lit(100.0).alias("h")) for x, s in ((0.0, 0.7), (10.0, 0.9), (300.0, 0.8))))
    assert [k.score for k in val(spark, arrays.non_max_suppression(boxes))] == [0.9, 0.8] and [k.x for k in val(spark, arrays.arrange_faces(boxes))] == [0.0, 10.0, 300.0]
    frames = spark.createDataFrame([(1, 4, 4, bytes(48)), (2, 4, 4, bytes(5)), (3, 16, 16, bytes(np.random.default_rng(1).integers(0, 256, 768).astype(np.uint8)))], "id bigint, width int, height int, rgb binary")
    got = {r.id: r for r in arrays.pixel_quality(frames).collect()}
    assert (got[1].sharpness, got[1].clip_shadows) == (0.0, 1.0) and got[2].sharpness is None and got[3].sharpness > 0
    h = frames.where("id = 1").select(arrays.histogram("rgb").alias("h")).first().h
    assert h.r[0] == 16 and sum(h.luma) == 16
    t = arrays.tile_weights(4, 1)
    assert t[0, 0] == 0.25 and t[1, 1] == 1.0
    tiles = spark.createDataFrame([(1, 0, 0, 2.0, 0.5), (1, 0, 0, 4.0, 0.5)], "id bigint, x int, y int, value double, weight double")
    assert rows(arrays.blend_tiles(tiles)) == [(1, 0, 0, 3.0)]


def test_sources(spark, tmp_path):
    (tmp_path / "p" / "sub").mkdir(parents=True)
    for n in ("p/a.JPG", "p/b.txt", "p/sub/c.cr3"):
        (tmp_path / n).write_bytes(b"x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in FolderSource(spark, str(tmp_path / "p")).scan().collect()) == ["a.JPG", "c.cr3"]
    assert FolderSource(spark, str(tmp_path / "p"), recursive=False).scan().count() == 1 and ListSource(spark, ["/x.jpg"]).scan().count() == 1
    with sqlite3.connect(tmp_path / "s.db") as con:
        con.executescript("CREATE TABLE PhotoTable(id INTEGER, filename TEXT, exposure_time INTEGER); INSERT INTO PhotoTable VALUES (1,'/a.jpg',5),(26,'/b.nef',9),(3,'/c.doc',1); CREATE TABLE TagTable(name TEXT, photo_id_list TEXT); INSERT INTO TagTable VALUES ('t','thumb0000000000000001,thumb000000000000001a,'),('u',NULL);")
    s = ShotwellSource(spark, str(tmp_path / "s.db"))
    assert [r.path for r in s.scan().collect()] == ["/b.nef", "/a.jpg"] and rows(s.tags()) == [("/a.jpg", "t"), ("/b.nef", "t")]
    with sqlite3.connect(tmp_path / "d.db") as con:
        con.executescript("""CREATE TABLE AlbumRoots(id, identifier, specificPath); CREATE TABLE Albums(id, albumRoot, relativePath); CREATE TABLE Images(id, album, name, status); CREATE TABLE ImageInformation(imageid, rating); CREATE TABLE Tags(id, pid, name); CREATE TABLE ImageTags(imageid, tagid);
        INSERT INTO AlbumRoots VALUES (1,'volumeid:?uuid=ab-1','/photos'); INSERT INTO Albums VALUES (1,1,'/2020'); INSERT INTO Images VALUES (1,1,'a.jpg',1),(2,1,'b.jpg',3),(3,1,'c.jpg',1); INSERT INTO ImageInformation VALUES (1,7),(3,-1);
        INSERT INTO Tags VALUES (1,0,'_Digikam_Internal_Tags_'),(2,1,'Pick Label Rejected'),(3,0,'Places'),(4,3,'Paris'); INSERT INTO ImageTags VALUES (1,2),(1,4);""")
    d = DigikamSource(spark, str(tmp_path / "d.db"))
    assert rows(d.scan()) == [("/photos/2020/a.jpg",), ("/photos/2020/c.jpg",)]
    assert rows(d.metadata()) == [("/photos/2020/a.jpg", 5, -1, ["Places|Paris"]), ("/photos/2020/c.jpg", None, None, [])]


def test_stream_imports_each_hash_once(spark, tmp_path):
    schema = "hash string, path string"
    put = lambda name, *r: spark.createDataFrame(list(r), schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    put("1", ("h1", "/a"), ("h1", "/b"), ("h2", "/c"), (None, "/n"))
    run = lambda: stream.start(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(90)
    run()
    put("2", ("h2", "/d"), ("h3", "/e"))
    run()
    got = rows(stream.accepted(spark, str(tmp_path / "out"), schema))
    assert got == [("h1", "/a"), ("h2", "/c"), ("h3", "/e"), (None, "/n")]  # rows without a hash stay, as in the batch import


def test_an_import_from_files_to_log(spark):
    schema = "id bigint, path string, filename string, original_filename string, size_bytes bigint, created_at bigint, hash string, rating int, group_hash string, imported_at bigint, format string"
    library = spark.createDataFrame([(1, "/l/a.jpg", "a.jpg", "A.JPG", 10, 100, "H1", 3, None, 1, "JPEG")], schema)
    log = spark.createDataFrame([], "id bigint, source string, started_at bigint, finished_at bigint, imported bigint, duplicates bigint, errors bigint, status string")
    files = spark.createDataFrame(
        [(10, "/l/a.jpg", "a.jpg", 99, None, "h9"), (11, "/c/a.jpg", "a.JPG", 10, 100, None), (12, "/c/b.jpg", "b.jpg", 5, 7, "h1"), (13, "/c/c.jpg", "c.jpg", 5, 7, "h2"), (14, "/c/d.jpg", "d.jpg", 6, 8, "H2"), (15, "/c/e.jpg", "e.jpg", 0, 8, "h3"), (16, "/c/c.orf", "c.orf", 50, 7, None), (16, "/c/c.orf", "c.orf", 50, 7, None)],
        "id bigint, path string, filename string, size_bytes bigint, created_at bigint, hash string",
    )
    assert dict(rows(ingest.accept(files, library, in_place=True))) == {10: "known", 11: "suspected", 12: "duplicate", 13: "new", 14: "duplicate", 15: "empty", 16: "new"}
    assert dict(rows(ingest.accept(files, library)))[10] == "new" and ingest.accept(files.limit(0), library).count() == 0
    after, done = ingest.import_files(library, log, files, "/c", 500, 501, in_place=True)
    new = {r.id: r for r in after.collect()}
    assert set(new) == {1, 13, 16} and new[13].rating == 0 and new[13].imported_at == 500 and new[16].format == "RAW_ORF" and new[13].group_hash == new[16].group_hash is not None
    assert rows(done) == [(1, "/c", 500, 501, 2, 4, 1, "complete")]
    assert rows(ingest.thumbnail_gaps(after.withColumn("missing", F.lit(False)), spark.createDataFrame([("H1",)], "hash string"))) == [("h2", 13)]
    planned = spark.createDataFrame([(1, "/p/x", 5, "h"), (2, "/p/y", 5, "h")], "id bigint, destination string, size_bytes bigint, hash string")
    assert rows(ingest.adoptable(planned, spark.createDataFrame([("/p/x", 5, "h"), ("/p/y", 6, "h")], "path string, size_bytes bigint, hash string"))) == [(1, "/p/x")]


def test_jobs_can_be_cancelled(spark):
    with cancellable(spark, "count") as cancel:
        threading.Timer(2, cancel).start()
        with pytest.raises(Exception, match="(?i)cancel"):
            spark.range(10**12).agg(F.max(F.xxhash64("id"))).collect()
    assert spark.range(3).count() == 3
