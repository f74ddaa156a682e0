"""The catalogue's relations over the given tables, in DataFrames and in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatable.functions.instants import COUNTINGS, GENUINE, MICROS, number_us
from lumatable.functions.text import strip_space
from lumatable.runtime import table

IMAGE_COLUMNS = [
    "id", "hash", "path", "filename", "original_filename", "size_bytes", "width", "height", "imported_at", "format", "has_sidecar", "metadata_json", "camera_make", "camera_model",
    "lens_model", "iso", "latitude", "longitude", "location_name", "rating", "flagged", "hidden", "title", "description", "orientation", "xmp_mtime", "missing", "color_label", "edited", "has_xcf",
]


def shot_key():
    """The key of a shot: its group, or the image alone where it has none."""
    return F.coalesce(F.col("group_hash"), F.concat(F.lit("id:"), F.col("id").cast("string")))


def image_rows(spark: SparkSession, sf_dir: str, years: tuple[int, int] = GENUINE) -> DataFrame:
    """Rows of images, copies included, with created_at in seconds, cleaned group_hash, shot_key, and the calendar parts of created_at.

    Filters on these rows reach the scan; `once` after them leaves one row an image. `years` are the seconds since 1970 between which
    a number counts as a time.
    """
    raw = table(spark, sf_dir, "images").select(*IMAGE_COLUMNS, "created_at", "group_hash", F.col("thumbhash").isNotNull().alias("has_thumbhash"))
    group = F.lower(strip_space(F.col("group_hash")))
    at = F.floor(number_us("created_at", years) / MICROS).cast("bigint")
    slim = raw.withColumns({"created_at": at, "group_hash": F.when(group != "", group)})
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("created_at") / 86_400).cast("int"))
    return slim.withColumns({"shot_key": shot_key(), "year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day)})


def once(images: DataFrame) -> DataFrame:
    """One row an image: copies of a row are equal, so a filter before keeps or drops all of them."""
    return images.dropDuplicates(["id"])


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images once each; columns a query does not ask for are never read."""
    return once(image_rows(spark, sf_dir))


def _seconds_sql(v: str) -> str:
    low, high = GENUINE
    cases = []
    for unit, epoch in COUNTINGS:
        cases.append(f"WHEN {v} >= {(low + epoch) * unit} AND {v} < {min((high + epoch) * unit, 2**63 - 1)} THEN ({v} - {epoch * unit}) // {unit}")
    cases.append(f"WHEN {v} BETWEEN 20120101000000 AND 20251231235959 THEN epoch_us(try_strptime(CAST({v} AS VARCHAR), '%Y%m%d%H%M%S')) // 1000000")
    return f"CASE {' '.join(cases)} END"


IMAGES_SQL = f"""
img0 AS (SELECT DISTINCT {', '.join(IMAGE_COLUMNS)}, CAST({_seconds_sql('created_at')} AS BIGINT) AS created_at, nullif(lower(trim(group_hash)), '') AS group_hash, thumbhash IS NOT NULL AS has_thumbhash FROM images),
img AS (SELECT *, coalesce(group_hash, 'id:' || CAST(id AS VARCHAR)) AS shot_key, CAST(date_part('year', to_timestamp(created_at) AT TIME ZONE 'UTC') AS INTEGER) AS year,
  CAST(date_part('month', to_timestamp(created_at) AT TIME ZONE 'UTC') AS INTEGER) AS month, CAST(date_part('day', to_timestamp(created_at) AT TIME ZONE 'UTC') AS INTEGER) AS day FROM img0)"""


def quality(spark: SparkSession, sf_dir: str, version: int = 2) -> DataFrame:
    """One reading of an image: of the given version, the last computed; readings that are no numbers are null."""
    real = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) & (F.col(c) >= 0), F.col(c)).alias(c)
    values = ["sharpness", "clip_shadows", "clip_highlights", "eye_sharpness", "aesthetic", "aesthetic_crop"]
    rows = table(spark, sf_dir, "image_quality").where(F.col("quality_version") == version).select("image_id", "computed_at", "faces", *map(real, values), F.col("crop_x").isNotNull().alias("has_crop"))
    best = F.max_by(F.struct(*rows.columns[1:]), F.struct("computed_at", *values)).alias("r")
    return rows.groupBy("image_id").agg(best).select("image_id", "r.*")


_REAL = lambda c: f"CASE WHEN NOT isnan({c}) AND NOT isinf({c}) AND {c} >= 0 THEN {c} END AS {c}"
QUALITY_SQL = f"""
q0 AS (SELECT DISTINCT image_id, computed_at, faces, {', '.join(map(_REAL, ('sharpness', 'clip_shadows', 'clip_highlights', 'eye_sharpness', 'aesthetic', 'aesthetic_crop')))}, crop_x IS NOT NULL AS has_crop FROM image_quality WHERE quality_version = 2),
q AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY computed_at DESC NULLS LAST, sharpness DESC NULLS LAST, clip_shadows DESC NULLS LAST, clip_highlights DESC NULLS LAST, eye_sharpness DESC NULLS LAST, aesthetic DESC NULLS LAST, aesthetic_crop DESC NULLS LAST) AS rn FROM q0) WHERE rn = 1)"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tags").select("id", strip_space(F.col("name")).alias("name"), "parent_id").distinct()


TAGS_SQL = "tg AS (SELECT DISTINCT id, trim(name) AS name, parent_id FROM tags)"


def image_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "image_tags").select("image_id", "tag_id").distinct()


IMAGE_TAGS_SQL = "it AS (SELECT DISTINCT image_id, tag_id FROM image_tags)"

# Named date ranges (closed, in seconds) and manual albums for the queries over them; no given table has any.
RANGES = ((1, "Spring tour", 1_396_310_400, 1_398_902_399), (2, "Conference", 1_397_000_000, 1_397_050_000), (3, "Whole 2016", 1_451_606_400, 1_483_228_799), (4, "June 2016", 1_464_739_200, 1_467_331_199), (5, "One day", 1_466_000_000, 1_466_086_399), (6, "Before all", 946_684_800, 978_307_199), (7, "Late years", 1_640_995_200, 1_735_689_599))
ALBUMS = ((1, "Best of", "rating = 5"), (2, "prints", "flagged = 1"), (3, "Archive", "edited"), (4, "Empty", "false"))


def ranges(spark: SparkSession) -> DataFrame:
    return spark.sql(f"WITH {RANGES_SQL} SELECT * FROM rg")


def albums(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}L, '{n}')" for i, n, _ in ALBUMS) + " t(album_id, name)")


def album_images(imgs: DataFrame) -> DataFrame:
    """Membership: the images that meet an album's condition, in order of id."""
    held = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(a).cast("bigint")) for a, _, c in ALBUMS)))
    return imgs.select(F.explode(held).alias("album_id"), F.col("id").alias("image_id"), F.col("id").alias("position"))


RANGES_SQL = "rg AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{n}', {a}::BIGINT, {b}::BIGINT)" for i, n, a, b in RANGES) + ") t(range_id, name, start_date, end_date))"
ALBUMS_SQL = (
    "al AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{n}')" for i, n, _ in ALBUMS) + ") t(album_id, name)), ai AS ("
    + " UNION ALL ".join(f"SELECT {i}::BIGINT AS album_id, id AS image_id, id AS position FROM img WHERE {c}" for i, _, c in ALBUMS) + ")"
)
