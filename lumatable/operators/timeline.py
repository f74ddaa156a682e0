"""Timelines: shots collapsed to tiles, calendar drill-downs, covers, sections and rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumatable.functions import scalars as S
from lumatable.functions.scalars import visible


def at():
    """The moment by which a timeline is ordered."""
    return F.coalesce("created_at", "imported_at")


def ordered(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(at()), F.desc("id"))


def collapse(files: DataFrame) -> DataFrame:
    """One tile a shot: the cover is the first file in timeline order that is not raw, else the first; the tile stands where the
    shot's first file stands. Counts only see the rows given, so filters come before.

    Copies of a row count once. A group is aggregated with partial sums on the map side, so a group with a third of all files does
    not gather in one task.
    """
    aspect = S.display_aspect(F.col("width"), F.col("height"), F.col("orientation"))
    files = files.select("id", "shot_key", at().alias("moment"), S.is_raw(F.col("format")).alias("raw"), "filename", "format", "rating", "flagged", "color_label", aspect.alias("aspect"), F.coalesce("edited", F.lit(False)).alias("edited"), F.coalesce("has_xcf", F.lit(False)).alias("has_xcf")).distinct()
    place, raw = F.struct("moment", "id"), F.col("raw")
    cover = F.struct((~raw).alias("plain"), place.alias("place"), F.col("filename").alias("filename"), F.col("format").alias("format"), F.col("rating").alias("rating"), F.col("flagged").alias("flagged"), F.col("color_label").alias("color_label"), F.col("aspect").alias("aspect"))
    tiles = files.groupBy("shot_key").agg(
        F.max(cover).alias("c"), F.max(place).alias("first"), F.count(F.lit(1)).alias("versions"), F.bool_or(raw).alias("any_raw"), F.bool_or("edited").alias("is_edited"), F.bool_or("has_xcf").alias("has_xcf")
    )
    return tiles.select(F.col("c.place.id").alias("id"), "c.filename", "c.format", "c.rating", "c.flagged", "c.color_label", "c.aspect", F.col("first.moment").alias("moment"), F.col("first.id").alias("first_id"), "versions", (F.col("any_raw") & F.col("c.plain")).alias("has_raw_version"), "is_edited", "has_xcf")


def in_order(tiles: DataFrame) -> DataFrame:
    return tiles.orderBy(F.desc_nulls_last("moment"), F.desc("first_id"))


def date_tree(images: DataFrame) -> DataFrame:
    """Distinct visible shots by day."""
    seen = images.where(visible() & (F.col("year") > 0))
    return seen.groupBy("year", "month", "day").agg(F.countDistinct("shot_key").alias("n_shots"))


def calendar(images: DataFrame, grain: list[str]) -> DataFrame:
    """Distinct shots at a grain of year, month and day; hidden files count here."""
    return images.where("year is not null").groupBy(*grain).agg(F.countDistinct("shot_key").alias("n_shots"))


def sidebar_totals(images: DataFrame) -> DataFrame:
    """Years and months as sums of their days, so a shot over two days counts twice; month null is the year's total."""
    days = date_tree(images)
    return days.rollup("year", "month").agg(F.sum("n_shots").alias("n_shots")).where("year is not null")


def covers(images: DataFrame, grain: list[str]) -> DataFrame:
    """Of each year and month, or day: the number of files and the earliest file."""
    first = F.min(F.struct("created_at", "id")).alias("first")
    return images.where("created_at is not null").groupBy(*grain).agg(F.count(F.lit(1)).alias("n_files"), first).select(*grain, "n_files", F.col("first.id").alias("cover_id"))


def sections(tiles: DataFrame) -> DataFrame:
    """Headers of a timeline: number of tiles by day, undated tiles under null."""
    return tiles.groupBy(S.day_of(F.col("moment")).alias("day_number")).agg(F.count(F.lit(1)).alias("n_tiles"))


def in_session(images: DataFrame, camera: str | None, start: int, end: int) -> DataFrame:
    """Files of a camera between two moments; no camera means files without one."""
    return images.where(F.col("camera_model").eqNullSafe(F.lit(camera)) & F.col("created_at").between(start, end))


def disagreeing_shots(images: DataFrame) -> DataFrame:
    """Shots whose files differ in rating, flag or colour; nulls do not count as values."""
    n = {c: F.countDistinct(c).alias(f"n_{c}") for c in ("rating", "flagged", "color_label")}
    return images.where("group_hash is not null").groupBy("group_hash").agg(*n.values()).where(" or ".join(f"n_{c} > 1" for c in n)).select("group_hash")


def pick_versions(files: DataFrame, mode: str) -> DataFrame:
    """Of each shot with a selected file (column selected): all, only raw or only other files; the selection where none is left."""
    w = Window.partitionBy("shot_key")
    fits = {"all": F.lit(True), "raw": S.is_raw(F.col("format")), "raster": ~S.is_raw(F.col("format"))}[mode]
    marked = files.withColumns({"__fits": fits, "__any": F.bool_or("selected").over(w)}).withColumn("__some", F.bool_or("__fits").over(w))
    return marked.where(F.col("__any") & F.when(F.col("__some"), F.col("__fits")).otherwise(F.col("selected"))).drop("__fits", "__any", "__some")


def justify(tiles: DataFrame, width: float, height: float, gap: float = 4.0) -> DataFrame:
    """Rows of tiles filled to a width, day by day: (day_number, row, id, left, height). A row closes when its tiles at the target
    height are as wide as asked; the last row of a day keeps the target height. Days are split by a pandas function, as packing
    is a sequential fold over one day's tiles."""

    def pack(day: pd.DataFrame) -> pd.DataFrame:
        day = day.sort_values(["moment", "first_id"], ascending=False, na_position="last")
        rows, row, held, number = [], [], 0.0, 0

        def close(full: bool) -> None:
            nonlocal row, held, number
            h = (width - gap * (len(row) - 1)) / held if full else height
            left = 0.0
            for i, a in row:
                rows.append((i, number, left, h))
                left += a * h + gap
            row, held, number = [], 0.0, number + 1

        for i, a in zip(day.id, day.aspect, strict=True):
            a = min(3.5, max(0.4, a))
            row.append((i, a))
            held += a
            if held * height + gap * (len(row) - 1) >= width:
                close(True)
        if row:
            close(False)
        return pd.DataFrame(rows, columns=["id", "row", "left", "height"]).assign(day_number=day.day_number.iloc[0])[["day_number", "row", "id", "left", "height"]]

    keyed = tiles.select(S.day_of(F.col("moment")).alias("day_number"), "id", "aspect", "moment", "first_id")
    return keyed.groupBy("day_number").applyInPandas(pack, "day_number bigint, row int, id bigint, left double, height double")


def unscored(images: DataFrame, quality: DataFrame, version: int, need_faces: bool = False, need_aesthetic: bool = False) -> DataFrame:
    """Files to score: without a reading, with one of another version, or lacking a model's output; no videos, missing or hidden files."""
    q = quality.select(F.col("image_id").alias("id"), "quality_version", "faces", "aesthetic")
    lacks = F.col("quality_version").isNull() | (F.col("quality_version") != version)
    lacks = lacks | F.col("faces").isNull() if need_faces else lacks
    lacks = lacks | F.col("aesthetic").isNull() if need_aesthetic else lacks
    return images.where(~S.is_video(F.col("format")) & ~F.coalesce("missing", F.lit(False)) & visible()).join(q, "id", "left").where(lacks).select(*images.columns)


def rail_marks(weights: list[tuple[float, float]], gap: float) -> list[float]:
    """Positions of marks on a rail, heaviest first, each at least `gap` from those chosen; a driver-side helper of a page."""
    chosen: list[float] = []
    for place, _ in sorted(weights, key=lambda x: (-x[1], x[0])):
        if all(abs(place - c) >= gap for c in chosen):
            chosen.append(place)
    return sorted(chosen)


def evict(files: DataFrame, most_bytes: int) -> DataFrame:
    """Cached files (path, bytes, accessed) to delete, least recently used first, until the rest fits; by running sums in ranges of
    access time, so that no single task sorts the whole cache."""
    total = files.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    hours = files.withColumn("slot", F.floor(F.unix_timestamp("accessed") / 3600))
    by_slot = hours.groupBy("slot").agg(F.sum("bytes").alias("slot_bytes"))
    before = by_slot.withColumn("before", F.sum("slot_bytes").over(Window.orderBy("slot")) - F.col("slot_bytes")).select("slot", "before")
    within = Window.partitionBy("slot").orderBy("accessed", "path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = hours.join(before, "slot").withColumn("freed_before", F.col("before") + F.sum("bytes").over(within) - F.col("bytes"))
    return run.where(F.col("freed_before") < total - most_bytes).select("path", "bytes", "accessed")

