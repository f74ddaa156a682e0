"""Points near other points, or inside round regions, on the sphere: complete radius joins with exact great-circle distances.

Space is parted into Voronoi cells around pivots. A point belongs to the cell of its nearest pivot; a region of centre q and
radius r goes to every cell c with d(q, c) <= d(q, own pivot) + 2 r, which by the triangle inequality covers every point the
region can hold. Within a cell a vantage-point tree over the region centres, with the largest radius of each branch, finds the
regions that hold a point.

Where a count proves the regions few, each task holds the whole index and the points are not shuffled at all. Otherwise both
sides are shuffled by cell. Pivots are drawn from the points and regions themselves, as many as their number asks for, so dense
places have many small cells; a cell that is still too large, as many points may lie at one place, is cut into blocks of
bounded size on both sides, so no task gets an unbounded cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatable.runtime import BROADCAST_ROWS, materialize, ship, table

EARTH_M = 6_371_008.8
#: Pivots of an index that is sent to all tasks, and the bounded sample they are chosen from.
PIVOTS, PIVOT_SAMPLE = 64, 2_000
#: Rows of either side in a block of a shuffled cell, rows for each of which there is a pivot, pivots at most, and rows compared with them at once.
BLOCK_ROWS, PIVOT_ROWS, MOST_PIVOTS, AT_ONCE = 50_000, 20_000, 1_024, 4_000
#: Metres by which bounds are widened against rounding; distances themselves are compared exactly.
SLACK_M = 1.0


def valid_position(lat: str, lon: str):
    """Whether a position counts: not null or NaN, within -90..90 and -180..180, and not exactly 0, 0."""
    a, b = F.col(lat), F.col(lon)
    return a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b) & a.between(-90, 90) & b.between(-180, 180) & ~((a == 0) & (b == 0))


def distance_m(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Great-circle distance in metres by haversines of angles in radians; arrays broadcast."""
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    return np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


def choose_pivots(lat: np.ndarray, lon: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Up to `most` pivots (lat, lon in radians) spread over the given places: each next one is the farthest from those chosen."""
    if not len(lat):
        return np.zeros((1, 2))
    chosen, nearest = [0], distance_m(lat, lon, lat[0], lon[0])
    while len(chosen) < most and nearest.max() > SLACK_M:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distance_m(lat, lon, lat[chosen[-1]], lon[chosen[-1]]))
    return np.column_stack([lat[chosen], lon[chosen]])


def cell_of(pivots: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Number of the nearest pivot of each point."""
    at, p = _unit(pivots[:, 0], pivots[:, 1]).T, _unit(lat, lon)
    return np.concatenate([(p[i : i + AT_ONCE] @ at).argmax(axis=1) for i in range(0, max(1, len(p)), AT_ONCE)])


def cells_reached(pivots: np.ndarray, lat: np.ndarray, lon: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Of each region, which cells may hold a point of it: a matrix of booleans."""
    d = distance_m(lat[:, None], lon[:, None], pivots[None, :, 0], pivots[None, :, 1])
    return d <= (d.min(axis=1) + 2 * radius + 2 * SLACK_M)[:, None]


class VantageTree:
    """Finds all regions that hold a point; built over region centres, queried for many points at once."""

    LEAF = 8

    def __init__(self, lat: np.ndarray, lon: np.ndarray, radius: np.ndarray):
        self.lat, self.lon, self.radius = lat, lon, radius
        self.root = self._build(np.arange(len(lat)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.LEAF:
            return rows
        v, rest = rows[0], rows[1:]
        d = distance_m(self.lat[rest], self.lon[rest], self.lat[v], self.lon[v])
        order = np.argsort(d, kind="stable")
        half = len(rest) // 2
        inner, outer = rest[order[:half]], rest[order[half:]]
        far_in, near_out = d[order[half - 1]], d[order[half]]
        return (v, far_in + self.radius[inner].max(), near_out - self.radius[outer].max(), self._build(inner), self._build(outer))

    def holding(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of (point number, region number)."""
        points, regions, stack = [], [], [(self.root, np.arange(len(lat)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if isinstance(node, tuple):
                v, most, least, inner, outer = node
                d = distance_m(lat[at], lon[at], self.lat[v], self.lon[v])
                hit = at[d <= self.radius[v]]
                points.append(hit)
                regions.append(np.full(len(hit), v))
                stack.append((inner, at[d <= most + SLACK_M]))
                stack.append((outer, at[d >= least - SLACK_M]))
            elif len(node):
                d = distance_m(lat[at][:, None], lon[at][:, None], self.lat[node][None, :], self.lon[node][None, :])
                i, j = np.nonzero(d <= self.radius[node][None, :])
                points.append(at[i])
                regions.append(node[j])
        return (np.concatenate(points), np.concatenate(regions)) if points else (np.zeros(0, int), np.zeros(0, int))


class CellIndex:
    """All regions by cell, each cell with its tree."""

    def __init__(self, ids, lat, lon, radius):
        self.ids, lat, lon = np.asarray(ids), np.radians(lat), np.radians(lon)
        step = max(1, len(lat) // PIVOT_SAMPLE)
        self.pivots = choose_pivots(lat[::step], lon[::step])
        reached = cells_reached(self.pivots, lat, lon, radius) if len(lat) else np.zeros((0, 1), bool)
        self.cells = {c: (rows, VantageTree(lat[rows], lon[rows], radius[rows])) for c in range(len(self.pivots)) if len(rows := np.nonzero(reached[:, c])[0])}

    def holding(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of (point number, region id)."""
        lat, lon = np.radians(lat), np.radians(lon)
        cell, points, regions = cell_of(self.pivots, lat, lon), [], []
        order = np.argsort(cell, kind="stable")
        for at in np.split(order, np.nonzero(np.diff(cell[order]))[0] + 1) if len(order) else []:
            if (got := self.cells.get(int(cell[at[0]]))) is not None:
                i, j = got[1].holding(lat[at], lon[at])
                points.append(at[i])
                regions.append(self.ids[got[0][j]])
        return (np.concatenate(points), np.concatenate(regions)) if points else (np.zeros(0, int), np.zeros(0, np.int64))


PAIRS = "point_id bigint, region_id bigint"


def _by_index(points: DataFrame, regions: pd.DataFrame) -> DataFrame:
    index = points.sparkSession.sparkContext.broadcast(CellIndex(regions.id.to_numpy(), regions.lat.to_numpy(), regions.lon.to_numpy(), regions.radius_m.to_numpy()))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            i, ids = index.value.holding(b.lat.to_numpy(), b.lon.to_numpy())
            yield pd.DataFrame({"point_id": b.id.to_numpy()[i], "region_id": ids})

    return points.mapInPandas(find, PAIRS)


def _by_cells(points: DataFrame, regions: DataFrame, block_rows: int) -> DataFrame:
    """Both sides shuffled by cell, in blocks: a cell of p and r blocks becomes p * r tasks' groups of bounded size."""
    places = points.select("id", "lat", "lon").unionByName(regions.select("id", "lat", "lon"))
    most = min(MOST_PIVOTS, max(PIVOTS, -(-places.count() // PIVOT_ROWS)))
    # the sample only decides where cells lie; results are the same for any
    sample = places.select("lat", "lon", F.xxhash64("id", "lat", "lon").alias("h")).orderBy("h").limit(2 * most).toPandas()
    lat, lon = np.radians(sample.lat.to_numpy()), np.radians(sample.lon.to_numpy())
    spread = choose_pivots(lat, lon, most // 2)  # half far from each other, half where most places are
    pivots = np.unique(np.concatenate([spread, np.column_stack([lat, lon])[: most - len(spread)]]), axis=0)

    def to_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(cell=cell_of(pivots, np.radians(b.lat.to_numpy()), np.radians(b.lon.to_numpy())).astype("int32"))

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), AT_ONCE):
                part = b.iloc[k : k + AT_ONCE]
                i, c = np.nonzero(cells_reached(pivots, np.radians(part.lat.to_numpy()), np.radians(part.lon.to_numpy()), part.radius_m.to_numpy()))
                yield part.iloc[i].assign(cell=c.astype("int32"))

    p = points.mapInPandas(to_cell, "id bigint, lat double, lon double, cell int")
    r = regions.mapInPandas(to_cells, "id bigint, lat double, lon double, radius_m double, cell int")
    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))
    size = F.broadcast(blocks(p, "p_blocks").join(blocks(r, "r_blocks"), "cell"))  # at most a row for each pivot
    number = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = p.join(size, "cell").withColumn("pb", number("p_blocks")).withColumn("rb", each("r_blocks")).select("cell", "pb", "rb", "id", "lat", "lon")
    r = r.join(size, "cell").withColumn("rb", number("r_blocks")).withColumn("pb", each("p_blocks")).select("cell", "pb", "rb", "id", "lat", "lon", "radius_m")

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tree = VantageTree(np.radians(right.lat.to_numpy()), np.radians(right.lon.to_numpy()), right.radius_m.to_numpy())
        i, j = tree.holding(np.radians(left.lat.to_numpy()), np.radians(left.lon.to_numpy()))
        return pd.DataFrame({"point_id": left.id.to_numpy()[i], "region_id": right.id.to_numpy()[j]})

    return p.groupBy("cell", "pb", "rb").cogroup(r.groupBy("cell", "pb", "rb")).applyInPandas(find, PAIRS)


def within_regions(points: DataFrame, regions: DataFrame, broadcast_rows: int = BROADCAST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Distinct pairs (point_id, region_id) of points (id, lat, lon) and round regions (id, lat, lon, radius_m) that hold them.

    A point on the rim is inside. Positions that are null, not numbers, out of range or exactly 0, 0 do not count, on either
    side, nor do regions with a null, NaN or negative radius. Repeated rows give a pair once; empty tables give none.
    """
    ship(points.sparkSession)
    p = points.select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).where(valid_position("lat", "lon") & F.col("id").isNotNull())
    r = regions.select("id", *(F.col(c).cast("double").alias(c) for c in ("lat", "lon", "radius_m"))).where(valid_position("lat", "lon") & F.col("id").isNotNull() & (F.col("radius_m") >= 0) & ~F.isnan("radius_m")).distinct()
    few = r.limit(broadcast_rows + 1).toPandas()  # the limit is the check and the bound: 200,001 rows of 32 bytes, 6.4 MB
    return (_by_index(p, few) if len(few) <= broadcast_rows else _by_cells(p, r, block_rows)).distinct()


def near_points(points: DataFrame, others: DataFrame, radius_m: float, **options) -> DataFrame:
    """Distinct pairs (point_id, region_id) of points and other points (id, lat, lon) at most `radius_m` apart, without pairs of the same id."""
    return within_regions(points, others.withColumn("radius_m", F.lit(float(radius_m))), **options).where("point_id != region_id")


def by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query p7_by_cells: the rows of p7_found with both sides shuffled by cell, as for regions too many to be sent to all tasks."""
    return _named(spark, sf_dir, broadcast_rows=0)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query p7_found: each image with the named places whose region holds it."""
    return _named(spark, sf_dir)


def _named(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    images = table(spark, sf_dir, "images").select("id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    places = table(spark, sf_dir, "places").select(F.col("place_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "radius_m")
    return within_regions(images, places, **options).select(F.col("point_id").alias("image_id"), F.col("region_id").alias("place_id"))


#: Metres within which p7_near looks for other positions.
NEAR_M = 100.0


def near_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query p7_near: for each image whose id is divisible by 20, how many positions and images lie within 100 m of it, itself left out:
    (image_id, n_positions, n_images).

    Images of one position are one class with their number, so a place with a third of all images is one row, and no pairs of its
    copies are made. A row for each image that has any.
    """
    images = table(spark, sf_dir, "images").select("id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).where(valid_position("lat", "lon") & F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("lat", "lon")).alias("p")).select("id", "p.lat", "p.lon")
    places = materialize(images.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("place")), "positions")
    asked = images.where("id % 20 = 0")
    pairs = within_regions(asked, places.select(F.col("place").alias("id"), "lat", "lon", F.lit(NEAR_M).alias("radius_m")))
    near = pairs.join(places.select(F.col("place").alias("region_id"), "n"), "region_id").groupBy("point_id").agg(F.count(F.lit(1)).alias("n_positions"), (F.sum("n") - 1).alias("n_images"))
    return near.where("n_images > 0").select(F.col("point_id").alias("image_id"), "n_positions", "n_images")
