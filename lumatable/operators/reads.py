"""Reads of the catalogue: pages, points, groups, searches with limits, and lists derived from selections."""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumatable.functions import scalars as S
from lumatable.operators.hierarchy import hierarchy
from lumatable.operators.tags import images_under
from lumatable.operators.timeline import at, ordered, pick_versions
from lumatable.runtime import materialize

#: Columns that full-text search looks at, and the weights of the BM25 ranking.
RANKED_COLUMNS, K1, B = ["filename", "camera_make", "camera_model", "lens_model", "title", "description"], 1.2, 0.75


def page(images: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of the images, newest first; an optimizer's top-k, so no full sort where the page lies near the start."""
    return ordered(images).offset(offset).limit(limit)


def by_id(images: DataFrame, image_id: int) -> DataFrame:
    return images.where(F.col("id") == image_id)


def id_of_path(images: DataFrame, path: str) -> DataFrame:
    return images.where(F.col("path") == path).select("id")


def at_paths(images: DataFrame, paths: DataFrame) -> DataFrame:
    """The images whose path is in a list (path), in any order."""
    return images.join(paths.select("path").distinct(), "path", "left_semi")


def of_calendar(images: DataFrame, year: int | None = None, month: int | None = None, day: int | None = None) -> DataFrame:
    """Images of a year, month or day, newest first; parts that are not given do not restrict. Hidden files count."""
    for name, value in (("year", year), ("month", month), ("day", day)):
        if value is not None:
            images = images.where(F.col(name) == value)
    return ordered(images)


def without_thumbhash(images: DataFrame) -> DataFrame:
    return images.where(~F.col("has_thumbhash"))


def integrity_listing(images: DataFrame) -> DataFrame:
    """What the library check needs of each visible file."""
    return images.where(S.visible()).select("id", "path", "missing", "has_sidecar", "has_xcf", "xmp_mtime")


def group_listing(images: DataFrame, group: str) -> DataFrame:
    """Files of a group in the order of format, nulls first, and name."""
    return images.where(F.col("group_hash") == group).orderBy(F.asc_nulls_first("format"), "filename", "id")


def shots_of(selected: DataFrame, images: DataFrame) -> DataFrame:
    """Selected files (id, place) by shot, in order of selection: (shot_key, place, versions, selected), both arrays of ids, versions in
    the order of format and name. Selected ids that do not exist are left out."""
    chosen = images.select("id", "shot_key").join(selected.groupBy("id").agg(F.min("place").alias("place")), "id")
    shots = chosen.groupBy("shot_key").agg(F.min("place").alias("place"), F.sort_array(F.collect_list("id")).alias("selected"))
    order = F.struct("format", "filename", "id")
    versions = images.join(shots.select("shot_key"), "shot_key", "left_semi").groupBy("shot_key").agg(F.sort_array(F.collect_list(order)).alias("v"))
    return shots.join(versions, "shot_key").select("shot_key", "place", F.transform("v", lambda x: x["id"]).alias("versions"), "selected").orderBy("place")


def distinct_shots(selected: DataFrame, images: DataFrame) -> DataFrame:
    """(n_shots) of the selected files (id)."""
    return images.join(selected.select("id").distinct(), "id", "left_semi").agg(F.countDistinct("shot_key").alias("n_shots"))


def first_seen(rows: DataFrame, key: str, place: str) -> DataFrame:
    """Rows without repeats of a key: the first of each, in order."""
    return rows.groupBy(key).agg(F.min(place).alias(place)).orderBy(place)


def ids_of_json(df: DataFrame, text: str) -> DataFrame:
    """(id) of JSON arrays of numbers; texts that are no such array give none."""
    return df.select(F.explode(F.from_json(text, "array<bigint>")).alias("id")).where("id is not null")


def library_search(images: DataFrame, text: str | None = None, year: int | None = None, month: int | None = None, day: int | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Search with calendar parts and a page; unlike a timeline's search it finds hidden files, too."""
    found = images.where(S.matches_text(text, RANKED_COLUMNS)) if text else images
    found = of_calendar(found, year, month, day)
    found = found.offset(offset) if offset else found
    return found if limit is None else found.limit(limit)


def ranked_search(images: DataFrame, text: str, limit: int) -> DataFrame:
    """(id, score) of the best matches of a text: BM25 of its words as prefixes over all text columns, then the larger id.

    A rare word counts more, a long entry less. The statistics are those of all images. A text without words matches nothing.
    """
    words = [S.fold_word(w) for w in S.search_words(text)]
    tokens = F.filter(F.split(F.lower(F.regexp_replace(F.concat_ws(" ", *RANKED_COLUMNS), r"[^\p{L}\p{N}]+", " ")), " "), lambda t: t != "")
    begins = lambda w: lambda t: S.begins_with(t, w.split()[-1])
    hits = [F.size(F.filter("tokens", begins(w))).alias(f"tf{i}") for i, w in enumerate(words)]
    if not words:
        return images.select("id", F.lit(0.0).alias("score")).limit(0)
    docs = images.select("id", tokens.alias("tokens")).select("id", F.size("tokens").alias("length"), *hits)
    n, mean, *df = docs.agg(F.count(F.lit(1)), F.avg("length"), *(F.count_if(F.col(f"tf{i}") > 0) for i in range(len(words)))).first()  # one row of statistics
    idf = [max(1e-6, log((n - d + 0.5) / (d + 0.5))) for d in df]
    tf = [F.col(f"tf{i}") for i in range(len(words))]
    part = lambda x, w: F.lit(w) * x * (K1 + 1) / (x + K1 * (1 - B + B * F.col("length") / F.lit(mean or 1.0)))
    score = reduce(lambda a, b: a + b, (part(x, w) for x, w in zip(tf, idf, strict=True)))
    return docs.where(reduce(lambda a, b: a & b, (x > 0 for x in tf))).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), F.desc("id")).limit(limit)


def trash_plan(images: DataFrame, selected: DataFrame, mode: str) -> DataFrame:
    """(id, path, trashed) of every version of the selected files' (id) shots: which go by the mode (all, raw or raster), and which stay,
    whose sidecars must be kept. A shot that the mode leaves empty loses what was selected."""
    marked = images.join(selected.select("id", F.lit(True).alias("selected")).distinct(), "id", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    goes = pick_versions(marked, mode).select("id", F.lit(True).alias("trashed"))
    shots = marked.where("selected").select("shot_key").distinct()
    return marked.join(shots, "shot_key", "left_semi").join(goes, "id", "left").select("id", "path", F.coalesce("trashed", F.lit(False)).alias("trashed"))


def tag_paths(tags: DataFrame) -> DataFrame:
    """(id, path) of every tag, names from the root joined by |; a tag on or below a cycle has its own name only."""
    paths = hierarchy(tags.select("id", F.col("parent_id").alias("parent"), "name")).select("id", F.array_join("path", "|").alias("path"), "depth")
    one = tags.groupBy("id").agg(F.min(F.coalesce("name", F.lit(""))).alias("name"))
    return one.join(paths, "id").select("id", F.when(F.col("depth") < 0, F.col("name")).otherwise(F.col("path")).alias("path"))


def tags_of_image(tags: DataFrame, image_tags: DataFrame, image_id: int) -> DataFrame:
    """(tag_id, path) of an image's tags in the order of their paths, by bytes."""
    held = image_tags.where(F.col("image_id") == image_id).select(F.col("tag_id").alias("id")).distinct()
    return tag_paths(tags).join(held, "id", "left_semi").select(F.col("id").alias("tag_id"), "path").orderBy("path")


def images_with_tag(tags: DataFrame, image_tags: DataFrame, images: DataFrame, name: str) -> DataFrame:
    """(id, path) of images with a tag of the name or one below it."""
    return images.join(images_under(tags, image_tags, name).withColumnRenamed("image_id", "id"), "id", "left_semi").select("id", "path")


def by_name(rows: DataFrame, name: str = "name") -> DataFrame:
    """Rows in the order of a name without regard to case; equal ones by their bytes."""
    return rows.orderBy(F.lower(name), name)


def row_tops(rows: DataFrame, gap: float) -> DataFrame:
    """Rows of tiles (day_number, row, height, one row each) with `top`, where each stands on the page, days newest first with a header
    of `gap` before each, and `header_row`, the first row of its day. Sums are taken within days, then over the days' sums."""
    rows = materialize(rows, "rows")
    days = rows.groupBy("day_number").agg((F.sum("height") + F.lit(gap)).alias("tall"), F.min("row").alias("header_row"))
    order = Window.orderBy(F.desc_nulls_last("day_number")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each day
    above = days.select(F.col("day_number").alias("d"), "header_row", F.coalesce(F.sum("tall").over(order), F.lit(0.0)).alias("above"))
    within = Window.partitionBy("day_number").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("height").over(within), F.lit(0.0))).join(above, F.col("day_number").eqNullSafe(F.col("d"))).select("day_number", "row", "header_row", (F.col("above") + gap + F.col("before")).alias("top"))


def moment_of(images: DataFrame) -> DataFrame:
    return images.select("id", at().alias("moment"))
