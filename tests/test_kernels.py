"""Array kernels on made inputs with known answers, and other managers' databases on volumes of their own."""

import sqlite3

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from lumatable.operators import arrays
from lumatable.sources.files import DigikamSource, apply_metadata, existing


def grids(at, score=1.0, size=np.log(10.0), eyes=((2.0, 2.0), (6.0, 2.0))):
    """Outputs with one face at a cell of the coarsest grid, and a weaker one that overlaps it."""
    out = []
    for stride in arrays.STRIDES:
        n = (arrays.FACE_FRAME // stride) ** 2
        out.append([np.zeros(n), np.ones(n), np.zeros((n, 4)), np.zeros((n, 10))])
    cls, _, boxes, marks = out[2]
    for place, s in ((at, score), (at + 1, 0.81 * score)):
        cls[place], boxes[place, 2:] = s, size
        marks[place] = np.array([*eyes, (4, 4), (3, 6), (5, 6)], dtype=float).ravel()
    return [tuple(x) for x in out]


def test_faces_are_decoded_and_kept_once():
    faces = arrays.decode_faces(grids(at=5 * 20 + 3), scale=0.5)
    assert len(faces) == 1 and faces[0]["score"] == 1.0
    assert (round(faces[0]["w"]), round(faces[0]["x"])) == (640, round((3 * 32 - 160) / 0.5)) and faces[0]["points"][0] == [(3 + 2) * 32 / 0.5, (5 + 2) * 32 / 0.5]
    assert arrays.decode_faces(grids(0, score=0.3), 1.0) == [] and arrays.decode_faces(grids(0, size=np.log(0.5)), 1.0) == []


def test_eyes_of_the_largest_face_that_can_be_judged(spark):
    rng = np.random.default_rng(3)
    noise, flat = rng.integers(0, 255, (120, 160, 3), dtype=np.uint8), np.full((120, 160, 3), 90, np.uint8)
    near = {"score": 0.9, "x": 0.0, "y": 0.0, "w": 150.0, "h": 110.0, "points": [[50.0, 60.0], [55.0, 60.0]]}
    far = {"score": 0.8, "x": 0.0, "y": 0.0, "w": 90.0, "h": 90.0, "points": [[40.0, 60.0], [90.0, 60.0]]}
    assert arrays.eye_sharpness(noise, near) is None and arrays.eye_sharpness(flat, far) < 1 < arrays.eye_sharpness(noise, far)
    schema = "id bigint, width int, height int, rgb binary, faces array<struct<score:double,x:double,y:double,w:double,h:double,points:array<array<double>>>>"
    df = spark.createDataFrame([(1, 160, 120, bytearray(noise.tobytes()), [near, far]), (2, 160, 120, bytearray(b"x"), [far]), (3, 160, 120, None, None), (4, 160, 120, bytearray(flat.tobytes()), [])], schema)
    got = {r.id: (r.faces, r.eye_sharpness) for r in arrays.judge_faces(df).collect()}
    assert got[1][0] == 2 and got[1][1] > 1 and got[2] == (1, None) and got[3] == (0, None) and got[4] == (0, None)
    assert arrays.judge_faces(df.limit(0)).count() == 0


def test_tiles_cover_and_crops_stay_inside(spark):
    sizes = spark.createDataFrame([(1, 1_000, 300), (2, 512, 513), (3, 0, 5), (4, None, None)], "id bigint, width int, height int")
    got = rows(arrays.tile_table(sizes))
    assert got == [(1, 0, 0, 512, 300), (1, 480, 0, 512, 300), (1, 488, 0, 512, 300), (2, 0, 0, 512, 512), (2, 0, 1, 512, 512)]
    crop = lambda *v: tuple(spark.range(1).select(arrays.crop_pixels(*map(F.lit, v)).alias("p")).first().p)
    assert crop(0.5, 0.0, 0.5, 1.0, 101, 50) == (51, 0, 50, 50) and crop(1.0, 1.0, 0.0, 0.0, 10, 10) == (9, 9, 1, 1) and crop(0.0, 0.0, 2.0, 2.0, 10, 10) == (0, 0, 10, 10)
    crops = arrays.crop_candidates(spark.createDataFrame([(1, 100, 100), (2, None, None)], "id bigint, width int, height int"))
    assert crops.where("id = 1").count() == 19 == crops.where("id = 1").distinct().count()


def test_roots_on_volumes_and_taking_over_metadata(spark, tmp_path):
    db = str(tmp_path / "d.db")
    with sqlite3.connect(db) as con:
        con.executescript("""CREATE TABLE AlbumRoots(id, identifier, specificPath); CREATE TABLE Albums(id, albumRoot, relativePath); CREATE TABLE Images(id, album, name, status);
        INSERT INTO AlbumRoots VALUES (1,'networkshareid:?path=%2Fmnt%2Fmy%20share','/p'),(2,'volumeid:?uuid=AB-1','/q'),(3,'volumeid:?uuid=zz','/r'),(4,NULL,NULL);
        INSERT INTO Albums VALUES (1,1,'/x'),(2,2,'/x'),(3,3,'/x'),(4,4,'/x'); INSERT INTO Images VALUES (1,1,'a.jpg',1),(2,2,'b.jpg',1),(3,3,'c.jpg',1),(4,4,'d.jpg',1);""")
    found = DigikamSource(spark, db, {"ab-1": "/media/disk"}).scan()
    assert rows(found) == [("/media/disk/q/x/b.jpg",), ("/mnt/my share/p/x/a.jpg",), ("/r/x/c.jpg",), ("/x/d.jpg",)]
    assert rows(existing(found, spark.createDataFrame([("/r/x/c.jpg",), ("/other",)], "path string"))) == [("/r/x/c.jpg",)]
    images = spark.createDataFrame([(1, "/a", 2, 0), (2, "/b", 3, 1)], "id bigint, path string, rating int, flagged int")
    known = spark.createDataFrame([("/a", 5, None, ["x", "y|z"]), ("/c", 1, 1, [])], "path string, rating int, flagged int, tags array<string>")
    after, tags = apply_metadata(images, known)
    assert rows(after) == [(1, "/a", 5, 0), (2, "/b", 3, 1)] and rows(tags) == [(1, "x"), (1, "y|z")]
