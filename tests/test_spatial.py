import numpy as np
from conftest import rows

from lumatable.operators.spatial import distance_m, near_points, within_regions

P, R = "id bigint, lat double, lon double", "id bigint, lat double, lon double, radius_m double"


def brute(points, regions):
    out = set()
    for i, a, o in points:
        for j, b, q, r in regions:
            if None not in (a, o, b, q, r) and distance_m(*map(np.radians, (a, o, b, q))) <= r:
                out.add((i, j))
    return sorted(out)


def sample(rng, n):
    return [(i, float(np.degrees(np.arcsin(rng.uniform(-1, 1)))), float(rng.uniform(-180, 180))) for i in range(n)]


def test_both_ways_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    points = sample(rng, 1_500) + [(9_000 + i, 89.99, float(v)) for i, v in enumerate(rng.uniform(-180, 180, 40))] + [(9_100 + i, 10.0, v) for i, v in enumerate((179.999, -179.999, 180.0, -180.0))]
    points += [(9_200 + i, 20.0, 20.0) for i in range(600)]  # a hot place
    regions = [(*p, float(r)) for p, r in zip(sample(rng, 120), rng.choice([1_000, 50_000, 900_000, 5_000_000], 120), strict=True)] + [(500, 90.0, 0.0, 20_000.0), (501, 10.0, 180.0, 300.0), (502, 20.0, 20.0, 0.0), (503, 20.0, 20.1, 30_000_000.0)]
    want = brute(points, regions)
    p, r = spark.createDataFrame(points, P), spark.createDataFrame(regions, R)
    assert sorted(rows(within_regions(p, r))) == want
    assert sorted(rows(within_regions(p, r, broadcast_rows=10, block_rows=400))) == want


def test_bad_positions_and_empty_tables(spark):
    nan = float("nan")
    p = spark.createDataFrame([(1, None, 1.0), (2, nan, 1.0), (3, 91.0, 1.0), (4, 0.0, 0.0), (5, 0.0, 0.001), (5, 0.0, 0.001), (None, 0.0, 0.001)], P)
    r = spark.createDataFrame([(1, 0.0, 0.001, 10.0), (2, 0.0, 0.001, None), (3, 0.0, 0.001, -1.0), (4, 0.0, 0.001, nan), (1, 0.0, 0.001, 10.0)], R)
    assert rows(within_regions(p, r)) == [(5, 1)]
    assert within_regions(p.limit(0), r).count() == within_regions(p, r.limit(0)).count() == 0


def test_near_points(spark):
    p = spark.createDataFrame([(1, 50.0, 8.0), (2, 50.0005, 8.0), (3, 51.0, 8.0)], P)
    assert rows(near_points(p, p, 100.0)) == [(1, 2), (2, 1)]
