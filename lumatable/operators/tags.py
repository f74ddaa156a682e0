"""Tags of images: closures over the tag tree, paths and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatable.functions.scalars import visible
from lumatable.operators.hierarchy import hierarchy
from lumatable.runtime import materialize


def last_segment(path: str) -> str:
    return path.rsplit("|", 1)[-1].strip()


def id_paths(tags: DataFrame) -> DataFrame:
    """(id, ids) with the ids from the root down to the tag; tags on or below a cycle have none. Kept in the shared folder."""
    paths = hierarchy(tags.select("id", F.col("parent_id").alias("parent"), F.col("id").cast("string").alias("name"))).where("depth >= 0")
    return materialize(paths.select("id", F.transform("path", lambda x: x.cast("bigint")).alias("ids"), "depth"), "tag-paths")


def images_under(tags: DataFrame, image_tags: DataFrame, path: str) -> DataFrame:
    """Ids of images with a tag of this name, or one below it; of a path the last part counts, letter case does not."""
    named = tags.where(F.lower("name") == last_segment(path).lower()).select(F.col("id").alias("named"))
    below = id_paths(tags).select("id", F.explode("ids").alias("named")).join(named, "named", "left_semi").select(F.col("id").alias("tag_id"))
    every = below.unionByName(named.select(F.col("named").alias("tag_id"))).distinct()
    return image_tags.join(every, "tag_id", "left_semi").select("image_id").distinct()


def with_counts(tags: DataFrame, image_tags: DataFrame, images: DataFrame) -> DataFrame:
    """(tag_id, name, n_shots): distinct visible shots of each tag that has any."""
    seen = images.where(visible()).select(F.col("id").alias("image_id"), "shot_key")
    n = image_tags.join(seen, "image_id").groupBy("tag_id").agg(F.countDistinct("shot_key").alias("n_shots"))
    return n.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")


def tree_counts(tags: DataFrame, image_tags: DataFrame, images: DataFrame) -> DataFrame:
    """(tag_id, direct_count, recursive_count): distinct shots with the tag, and the sum of these over the tag and all below it,
    which counts a shot twice that has both. Tags on or below cycles count directly only."""
    seen = images.where(visible()).select(F.col("id").alias("image_id"), "shot_key")
    direct = image_tags.join(seen, "image_id").groupBy("tag_id").agg(F.countDistinct("shot_key").alias("n"))
    paths = id_paths(tags)
    up = paths.join(direct.withColumnRenamed("tag_id", "id"), "id").select(F.explode("ids").alias("tag_id"), "n").groupBy("tag_id").agg(F.sum("n").alias("recursive"))
    every = tags.select(F.col("id").alias("tag_id")).distinct()
    return every.join(direct, "tag_id", "left").join(up, "tag_id", "left").select("tag_id", F.coalesce("n", F.lit(0)).alias("direct_count"), F.coalesce("recursive", "n", F.lit(0)).alias("recursive_count"))


def of_images(selected: DataFrame, tags: DataFrame, image_tags: DataFrame, images: DataFrame) -> DataFrame:
    """(tag_id, name, n_shots): tags on any file of the selected images' shots, with the number of those shots."""
    shots = images.join(selected, "id", "left_semi").select("shot_key").distinct()
    members = images.join(shots, "shot_key", "left_semi").select(F.col("id").alias("image_id"), "shot_key")
    n = image_tags.join(members, "image_id").groupBy("tag_id").agg(F.countDistinct("shot_key").alias("n_shots"))
    return n.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")


def expand_shots(selected: DataFrame, images: DataFrame) -> DataFrame:
    """Ids of all files of the selected images' shots."""
    shots = images.join(selected, "id", "left_semi").select("shot_key").distinct()
    return images.join(shots, "shot_key", "left_semi").select("id")
