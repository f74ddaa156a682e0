"""Bursts against a plain fold on random input, and the rules on small cases with exact answers."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lumatable.operators import quality as Q
from lumatable.operators.bursts import find_bursts

FILES = "id bigint, created_at bigint, camera string, shot_key string"


def plain_fold(files):
    out, members = {}, []

    def close():
        if len({m[3] for m in members}) > 1:
            out.update({m[0]: members[0][0] for m in members})

    for f in sorted((f for f in files if f[1] is not None), key=lambda f: (f[1], f[0])):
        if members and (f[3] in {m[3] for m in members} or (f[1] - members[-1][1] <= 2 and f[2] == members[-1][2])):
            members.append(f)
        else:
            close()
            members = [f]
    close()
    return out


def test_edge_cases(spark):
    files = [(1, 1000, "A"), (2, 1001, "A"), (3, 1002, "A"), (4, 1010, "A"), (5, 1011, "B"), (6, 1020, "A"), (7, 1020, "A"), (8, None, "A")]
    got = rows(find_bursts(spark.createDataFrame([(*f, f"id:{f[0]}") for f in files], FILES)))
    assert got == [(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)]


@pytest.mark.parametrize("seed", range(3))
def test_random_files(spark, seed):
    rng = random.Random(seed)
    files, t = [], 3_590
    for i in range(400):
        t += rng.choice([0, 1, 2, 3, 3, 50, 4_000])
        files.append((i, None if rng.random() < 0.05 else t + rng.choice([0, 0, 0, 700, 9_000]), rng.choice(["A", "A", "B", None]), f"s{rng.randint(0, 200)}"))
    assert dict(rows(find_bursts(spark.createDataFrame(files, FILES)))) == plain_fold(files)


QUALITY = "image_id bigint, sharpness double, eye_sharpness double, clip_highlights double, clip_shadows double, aesthetic double, aesthetic_crop double, has_crop boolean"


def judged(spark, files, readings, reference=(None, None, None)):
    f = spark.createDataFrame([(i, t, "A", s or f"id:{i}", fl, "JPEG") for i, t, s, fl in files], FILES + ", flagged int, format string")
    q = spark.createDataFrame([(r[0], r[1], *r[2:], *[None] * (8 - len(r))) for r in readings], QUALITY)
    ref = spark.createDataFrame([reference], "median_sharpness double, eye_p80 double, weak_below double")
    return {r.id: (r.reason, r.ticked) for r in Q.suggestions(f, q, ref).collect()}, f, q


def test_burst_and_files_alone(spark):
    files = [(1, 1000, None, 0), (2, 1001, None, 0), (3, 1002, None, 1), (4, 2000, None, 0)]
    got, f, q = judged(spark, files, [(1, 100.0), (2, 30.0), (3, 25.0), (4, 500.0, None, 0.35)])
    assert got == {2: ("blurred", True), 4: ("highlights", True)}
    assert rows(Q.keepers(f, q)) == [(1, 1)]


def test_burnt_burst_keeps_its_best(spark):
    got, *_ = judged(spark, [(1, 100, None, 0), (2, 101, None, -1), (3, 102, None, 0)], [(1, 100.0, None, 0.4), (2, 10.0, None, 0.4), (3, 90.0, None, 0.4)])
    assert got == {3: ("highlights", True)}


def test_blurred_pair_is_one_shot(spark):
    files = [(113, 1_704_122_012, "b9", 0), (105, 1_704_122_012, "b9", 0), (119, 1_704_122_077, "b3", 0), (121, 1_704_122_077, "b3", 0)]
    got, *_ = judged(spark, files, [(113, 23.0), (105, 23.8), (119, 814.0), (121, 845.0)], (1348.0, None, None))
    assert set(got) == {105, 113}


def test_eyes_of_a_session(spark):
    t0 = 1_704_122_012
    data = [(646, 0, 32.0), (647, 65, 129.0), (648, 567, 49.0), (649, 573, 100.0), (650, 628, 48.0), (651, 631, 55.0), (652, 634, 116.0), (653, 638, 79.0)]
    got, *_ = judged(spark, [(i, t0 + t, None, 0) for i, t, _ in data], [(i, 2000.0, e) for i, _, e in data], (1348.0, None, None))
    assert set(got) == {646, 648, 650, 651}
    alone = [(651, t0, None, 0)]
    assert judged(spark, alone, [(651, 2000.0, 55.0)], (1348.0, None, None))[0] == {}
    assert judged(spark, alone, [(651, 2000.0, 55.0)], (1348.0, 116.0, None))[0] == {651: ("eyes blurred", True)}
    assert judged(spark, [(651, None, None, 0)], [(651, 2000.0, 55.0)], (1348.0, 116.0, None))[0] == {}


def test_taste_in_a_burst(spark):
    files = [(1, 10, None, 0), (2, 11, None, 0), (3, 12, None, 0), (4, 13, None, 0)]
    scores = [(1, 1000.0, None, 0.0, 0.0, 5.3), (2, 950.0, None, 0.0, 0.0, 5.6), (3, 900.0, None, 0.0, 0.0, 4.9), (4, 300.0, None, 0.0, 0.0, 6.5)]
    got, f, q = judged(spark, files, scores)
    assert got == {3: ("less liked", False), 4: ("blurred", True)} and rows(Q.keepers(f, q)) == [(1, 2)]
    got, f, q = judged(spark, files, [s if s[0] != 3 else (*s[:5], None) for s in scores])
    assert got == {4: ("blurred", True)} and rows(Q.keepers(f, q)) == [(1, 1)]


def test_weak_taste_and_crops(spark):
    files = [(i, i * 10_000, None, 0) for i in (1, 2, 3)]
    scores = [(i, 900.0, None, 0.0, 0.0, 4.3) for i in (1, 2, 3)]
    got, f, q = judged(spark, files, scores, (1000.0, None, 4.6))
    assert got == dict.fromkeys((1, 2, 3), ("weak", False))
    suggested = spark.createDataFrame([(i, "weak", False) for i in (1, 2, 3)], "id bigint, reason string, ticked boolean")
    assert sorted(r.id for r in Q.needs_crop_check(f, q, suggested).collect()) == [1, 2, 3]
    after = [(1, 900.0, None, 0.0, 0.0, 4.3, 5.2, True), (2, 900.0, None, 0.0, 0.0, 4.3, 4.45, True), (3, 900.0, None, 0.0, 0.0, 4.3, 4.3, False)]
    assert set(judged(spark, files, after, (1000.0, None, 4.6))[0]) == {2, 3}


def test_references_and_grades(spark):
    v = spark.createDataFrame([(1, 120.5), (2, 900.0), (3, 30.0), (4, None)], "image_id bigint, sharpness double")
    assert Q.upper_median(v, "sharpness").first()[0] == 120.5 and Q.upper_median(v.where("image_id < 3"), "sharpness").first()[0] == 900.0
    a = spark.createDataFrame([(i, 3.0 + 0.03 * i) for i in range(100)], "image_id bigint, aesthetic double")
    assert abs(Q.nearest_percentile(a, "aesthetic", 0.1, least=30).first()[0] - 3.3) < 0.05
    assert Q.nearest_percentile(a.limit(29), "aesthetic", 0.1, least=30).first()[0] is None is Q.upper_median(v.limit(0), "sharpness").first()[0]
    assert Q.aesthetic_rank(a, 3.3).first().n_total == 100
    from lumatable.functions.scalars import grade, percent_of

    g = spark.createDataFrame([(55.0,), (79.0,), (70.0,), (129.0,)], "e double").select(grade(percent_of(F.col("e"), F.lit(116.0))).alias("g"))
    assert [r.g for r in g.collect()] == ["Bad", "Fair", "Poor", "Good"]
