"""Percentiles per group of very large numeric columns, from partial results that can be kept and combined.

A partial result holds how often each value occurs in each group: counts of disjoint inputs (days, partitions) add up to those
of the whole, so percentiles of any combination are exact: the rank error is 0. Ranks are found by cumulative frequencies: values
are cut into ranges by quantiles of the whole column, running sums are taken within each range, and the sums of the ranges
before are added; so a group with a third of all rows is spread over as many tasks as there are ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumatable.functions.text import camera_key
from lumatable.runtime import materialize, table

#: Percentiles asked for, and value ranges a group is cut into.
PERCENTS = (1, 10, 50, 80, 90, 99)
RANGES = 64
#: Stated bound of the error in rank, as a share of a group's rows.
RANK_ERROR = 0.0


def value_counts(readings: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """A partial result: (keys, value, n). Null, NaN, infinite and negative readings do not count; -0.0 counts as 0.0."""
    v = F.col(value)
    real = v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < F.lit(float("inf")))
    return readings.where(real).groupBy(*keys, F.abs(v).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def combine(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Partial results of disjoint inputs put together, for the same or for coarser groups."""
    return partials.groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, keys: list[str], by: str | None = None, percents: tuple[int, ...] = PERCENTS, ranges: int = RANGES) -> DataFrame:
    """n_values and p01, p10, ... of each group of a partial result: the smallest value whose cumulative count reaches
    ceil(p * n / 100). `by` names the key whose columns are cut into ranges separately. Null keys form groups of their own."""
    steps = [i / ranges for i in range(1, ranges)]
    cut = F.percentile_approx("value", F.array(*map(F.lit, steps)), F.lit(1_000)).alias("cuts")
    of = F.col(by) if by else F.lit(0)
    cuts = counts.groupBy(of.alias("__by")).agg(cut)  # a row of `ranges` numbers for each column measured
    placed = counts.withColumn("__of", of).join(F.broadcast(cuts), F.col("__of").eqNullSafe(F.col("__by")), "left")
    # a struct of the keys equals itself whatever is null in it, so all steps below share one partitioning
    placed = placed.select(F.struct(*keys).alias("g"), F.size(F.filter("cuts", lambda c: c < F.col("value"))).alias("part"), "value", "n")
    within = Window.partitionBy("g", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.withColumn("upto", F.sum("n").over(within))
    sums = running.groupBy("g", "part").agg(F.max("upto").alias("of_part"))
    order = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sums.select("g", "part", (F.sum("of_part").over(order) - F.col("of_part")).alias("before"), F.sum("of_part").over(Window.partitionBy("g")).alias("n_values"))
    ranked = running.join(offsets, ["g", "part"]).withColumn("upto", F.col("upto") + F.col("before"))
    reaches = lambda p: F.col("upto") >= F.call_function("div", F.col("n_values") * p + 99, F.lit(100))
    picked = ranked.groupBy("g").agg(F.first("n_values").alias("n_values"), *(F.min(F.when(reaches(p), F.col("value"))).alias(f"p{p:02d}") for p in percents))
    return picked.select("g.*", "n_values", *(f"p{p:02d}" for p in percents))


KEYS = ["camera_model", "quality_version", "day", "field_name"]


def daily_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partial results of image_quality to keep: (camera_model, quality_version, day, field_name, value, n).

    A repeated reading counts once. An image without a camera, or missing from images, has a null camera_model.
    """
    readings = table(spark, sf_dir, "image_quality").select("image_id", "quality_version", "computed_at", "sharpness", "eye_sharpness").distinct()
    cameras = table(spark, sf_dir, "images").select(F.col("id").alias("image_id"), camera_key(F.col("camera_model")).alias("camera_model")).where("image_id is not null").groupBy("image_id").agg(F.min("camera_model").alias("camera_model"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("computed_at") / 86_400).cast("int"))
    fields = F.explode(F.array(*(F.struct(F.lit(f"ImageQuality.{c}").alias("field_name"), F.col(c).alias("value")) for c in ("sharpness", "eye_sharpness"))))
    long = readings.join(cameras, "image_id", "left").select("camera_model", "quality_version", day.alias("day"), fields.alias("f")).select("camera_model", "quality_version", "day", "f.field_name", "f.value")
    return value_counts(long, KEYS)


def quality_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query p2_percentiles: by camera, version and day, and overall (day null), the percentiles of both sharpness readings."""
    daily = materialize(daily_partials(spark, sf_dir), "partials")
    overall = combine(daily, ["camera_model", "quality_version", "field_name"]).withColumn("day", F.lit(None).cast("date"))
    scoped = daily.withColumn("scope", F.lit("day")).unionByName(overall.withColumn("scope", F.lit("overall")))
    return percentiles(scoped, ["scope", *KEYS], by="field_name").withColumn("day", F.col("day").cast("string"))


def _sql() -> str:
    from lumatable.llm.sql import CAMERA

    ranks = ", ".join(f"min(CASE WHEN upto >= (n_values * {p} + 99) // 100 THEN value END) AS p{p:02d}" for p in PERCENTS)
    return f"""
WITH q AS (SELECT DISTINCT image_id, quality_version, computed_at, sharpness, eye_sharpness FROM image_quality),
c AS (SELECT id AS image_id, min({CAMERA}) AS camera_model FROM images WHERE id IS NOT NULL GROUP BY id),
l AS (SELECT camera_model, quality_version, DATE '1970-01-01' + CAST(floor(computed_at / 86400) AS INTEGER) AS day, field_name, value
  FROM (SELECT *, 'ImageQuality.sharpness' AS field_name, sharpness AS value FROM q UNION ALL SELECT *, 'ImageQuality.eye_sharpness', eye_sharpness FROM q) LEFT JOIN c USING (image_id)
  WHERE value IS NOT NULL AND NOT isnan(value) AND value >= 0 AND value < 'infinity'::DOUBLE),
s AS (SELECT 'day' AS scope, * FROM l UNION ALL SELECT 'overall', camera_model, quality_version, NULL, field_name, value FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY scope, camera_model, quality_version, day, field_name ORDER BY value) AS upto,
  count(*) OVER (PARTITION BY scope, camera_model, quality_version, day, field_name) AS n_values FROM s)
SELECT scope, camera_model, quality_version, CAST(day AS VARCHAR) AS day, field_name, any_value(n_values) AS n_values, {ranks}
FROM r GROUP BY scope, camera_model, quality_version, day, field_name"""


SQL = {"p2_percentiles": _sql}
