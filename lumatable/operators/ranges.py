"""Named date ranges: closed intervals over images' moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumatable.runtime import broadcast_within

DAY_S = 86_400


def by_day(ranges: DataFrame) -> DataFrame:
    """Ranges once for each day they touch, so that other tables meet them by an equality; broadcast where a count proves them few."""
    span = F.sequence(F.floor(F.col("start_date") / DAY_S), F.floor(F.col("end_date") / DAY_S))
    return broadcast_within(ranges.where("start_date <= end_date").withColumn("day", F.explode(span)))[0]


def containing(images: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pairs (id, range_id, length) of images and ranges that hold their moment."""
    moments = images.where("created_at is not null").select("id", "created_at").withColumn("day", F.floor(F.col("created_at") / DAY_S))
    length = (F.col("end_date") - F.col("start_date")).alias("length")
    return moments.join(by_day(ranges), "day").where("created_at between start_date and end_date").select("id", "range_id", length)


def with_counts(images: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each range with its number of files, 0 where it has none."""
    n = containing(images, ranges).groupBy("range_id").agg(F.count(F.lit(1)).alias("n"))
    return ranges.join(n, "range_id", "left").select("range_id", "name", "start_date", F.coalesce("n", F.lit(0)).alias("n_files"))


def narrowest(images: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, range_id) of the narrowest range that holds each image; the smaller range_id among equally narrow ones."""
    best = containing(images, ranges).groupBy("id").agg(F.min(F.struct("length", "range_id")).alias("best"))
    return best.select("id", F.col("best.range_id").alias("range_id"))


def of_days(days: DataFrame, ranges: DataFrame) -> DataFrame:
    """(day_start, range_id): the narrowest range that overlaps each day, of days given by their first second, at midnight."""
    hit = days.withColumn("day", F.floor(F.col("day_start") / DAY_S)).join(by_day(ranges), "day")
    rank = Window.partitionBy("day_start").orderBy(F.col("end_date") - F.col("start_date"), "range_id")
    return hit.withColumn("rn", F.row_number().over(rank)).where("rn = 1").select("day_start", "range_id")


def name_day(ranges: DataFrame, name: str, day_start: int) -> DataFrame:
    """Ranges after naming a day: the narrowest one that overlaps it is renamed, else a one-day range is added."""
    day = ranges.sparkSession.createDataFrame([(day_start,)], "day_start bigint")
    hit = of_days(day, ranges)
    renamed = ranges.join(hit.select("range_id", F.lit(True).alias("hit")), "range_id", "left").withColumn("name", F.when(F.col("hit"), F.lit(name)).otherwise(F.col("name"))).drop("hit")
    fresh = ranges.agg(F.coalesce(F.max("range_id"), F.lit(0))).first()[0] + 1
    new = day.join(hit, "day_start", "left_anti").select(F.lit(fresh).cast("bigint").alias("range_id"), F.lit(name).alias("name"), F.col("day_start").alias("start_date"), (F.col("day_start") + DAY_S - 1).alias("end_date"))
    return renamed.select("range_id", "name", "start_date", "end_date").unionByName(new)
