"""Changes to catalogue tables as copies: each function returns the table after the change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumatable.functions import scalars as S


def set_values(table: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Rows of `updates` (key, columns) replace these columns where the key is found; the largest row counts for a repeated key."""
    cols = [c for c in updates.columns if c != key]
    one = updates.groupBy(key).agg(F.max(F.struct(*cols)).alias("__new"))
    j = table.join(one, key, "left")
    return j.select(*(F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in table.columns))


def set_for(table: DataFrame, ids: DataFrame, key: str = "id", **values) -> DataFrame:
    """One value for all the given ids; ratings are clamped to 0..5 and flags to -1..1."""
    limits = {"rating": (0, 5), "flagged": (-1, 1)}
    return set_values(table, ids.select(key, *(F.lit(max(limits[c][0], min(limits[c][1], v)) if c in limits and v is not None else v).alias(c) for c, v in values.items())), key)


def set_for_shots(images: DataFrame, ids: DataFrame, **values) -> DataFrame:
    """Values for all files of the given files' shots."""
    shots = images.join(ids, "id", "left_semi").select("shot_key").distinct()
    return set_for(images, images.join(shots, "shot_key", "left_semi").select("id"), **values)


def shift_time(images: DataFrame, ids: DataFrame, seconds: int) -> DataFrame:
    """Adds to the moment of all dated files of the given files' shots."""
    shots = images.join(ids, "id", "left_semi").select("shot_key").distinct().withColumn("__hit", F.lit(True))
    return images.join(shots, "shot_key", "left").withColumn("created_at", F.when(F.col("__hit"), F.col("created_at") + seconds).otherwise(F.col("created_at"))).select(*images.columns)


def rotate(images: DataFrame, ids: DataFrame, clockwise: bool = True) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    return images.join(hit, "id", "left").withColumn("orientation", F.when(F.col("__hit"), S.rotate(F.col("orientation"), clockwise)).otherwise(F.col("orientation"))).select(*images.columns)


def delete_with_children(images: DataFrame, children: dict[str, DataFrame], ids: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The images without the given ids, and each child table without their rows (image_id)."""
    gone = ids.select("id").distinct()
    return images.join(gone, "id", "left_anti"), {k: t.join(gone.select(F.col("id").alias("image_id")), "image_id", "left_anti") for k, t in children.items()}


def restore(images: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows put back with their ids where these are free; all columns are kept."""
    return images.unionByName(rows.join(images.select("id"), "id", "left_anti"), allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those of the same key, and are added where it is new."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def upsert_quality(table: DataFrame, new: DataFrame) -> DataFrame:
    """Readings after saving new ones: a null aesthetic keeps the old one; crop columns are kept only where the new aesthetic is null."""
    crop = {"aesthetic_crop", "crop_x", "crop_y", "crop_w", "crop_h"} & set(table.columns)
    n = new.select("image_id", *(F.col(c).alias(f"n_{c}") if c in new.columns else F.lit(None).alias(f"n_{c}") for c in table.columns if c != "image_id"), F.lit(True).alias("is_new"))
    j = table.withColumn("is_old", F.lit(True)).join(n, "image_id", "full_outer")

    def value(c: str) -> Column:
        if c == "image_id":
            return F.col(c)
        if c == "aesthetic":
            return F.coalesce("n_aesthetic", "aesthetic").alias(c)
        if c in crop:
            return F.when(F.col("is_new") & F.col("n_aesthetic").isNotNull(), F.col(f"n_{c}")).otherwise(F.coalesce(c, f"n_{c}") if c != "aesthetic_crop" else F.coalesce(c, f"n_{c}")).alias(c)
        return F.when(F.col("is_new"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)

    return j.select(*map(value, table.columns))


def tag_images(image_tags: DataFrame, ids: DataFrame, tag_id: int) -> DataFrame:
    fresh = ids.select(F.col("id").alias("image_id"), F.lit(tag_id).cast("bigint").alias("tag_id")).distinct()
    return image_tags.unionByName(fresh.join(image_tags, ["image_id", "tag_id"], "left_anti"), allowMissingColumns=True)


def untag_images(image_tags: DataFrame, ids: DataFrame, tag_ids: DataFrame) -> DataFrame:
    images = ids.select(F.col("id").alias("image_id"), F.lit(True).alias("__i")).distinct()
    tags = tag_ids.select("tag_id", F.lit(True).alias("__t")).distinct()
    marked = image_tags.join(images, "image_id", "left").join(tags, "tag_id", "left")
    return marked.where("__i is null or __t is null").select(*image_tags.columns)


def delete_unused_tags(tags: DataFrame, image_tags: DataFrame, names: list[str]) -> DataFrame:
    """Tags without those of the given names that no image and no child uses."""
    named = tags.where(F.lower("name").isin([n.lower() for n in names]))
    unused = named.join(image_tags.select(F.col("tag_id").alias("id")), "id", "left_anti").join(tags.select(F.col("parent_id").alias("id")), "id", "left_anti")
    return tags.join(unused.select("id"), "id", "left_anti")


def ensure_tag_path(tags: DataFrame, path: str) -> DataFrame:
    """Tags with each part of a path such as A|B|C; names are unique whatever their case, so an existing tag is used, and gets a
    parent only where it has none. One pass over the few names of a path, on the driver."""
    parts = [p.strip() for p in path.replace("/", "|").split("|") if p.strip()]
    known = {r.key: (r.id, r.parent_id) for r in tags.where(F.lower("name").isin([p.lower() for p in parts])).select(F.lower("name").alias("key"), "id", "parent_id").collect()}  # at most the path's parts
    top = tags.agg(F.max("id").alias("m")).first().m or 0
    parent, fresh, moved = None, [], []
    for p in parts:
        if p.lower() in known:
            i, has = known[p.lower()]
            if has is None and parent is not None and parent != i:
                moved.append((i, parent))
        else:
            top += 1
            i = top
            fresh.append((i, p, parent))
            known[p.lower()] = (i, parent)
        parent = i
    spark = tags.sparkSession
    out = set_values(tags, spark.createDataFrame(moved, "id bigint, parent_id bigint")) if moved else tags
    return out.unionByName(spark.createDataFrame(fresh, "id bigint, name string, parent_id bigint"), allowMissingColumns=True) if fresh else out


def add_to_album(members: DataFrame, album_id: int, ids: DataFrame) -> DataFrame:
    """Album members (album_id, image_id, position) with new ones at the end, in order of id; members already there stay."""
    fresh = ids.select(F.lit(album_id).cast("bigint").alias("album_id"), F.col("id").alias("image_id")).distinct().join(members, ["album_id", "image_id"], "left_anti")
    after = members.where(F.col("album_id") == album_id).agg(F.coalesce(F.max("position"), F.lit(-1))).first()[0] + 1
    placed = fresh.withColumn("rn", F.row_number().over(Window.partitionBy("album_id").orderBy("image_id")) - 1)
    return members.unionByName(placed.select("album_id", "image_id", (F.col("rn") + after).cast("bigint").alias("position")))


def remove_from_album(members: DataFrame, album_id: int, ids: DataFrame) -> DataFrame:
    return members.join(ids.select(F.lit(album_id).cast("bigint").alias("album_id"), F.col("id").alias("image_id")), ["album_id", "image_id"], "left_anti")


def album_covers(members: DataFrame) -> DataFrame:
    """(album_id, cover_image_id): the member of the smallest position."""
    return members.groupBy("album_id").agg(F.min(F.struct("position", "image_id")).alias("c")).select("album_id", F.col("c.image_id").alias("cover_image_id"))


def log_change(log: DataFrame, before: DataFrame, kind: str, at: int) -> DataFrame:
    """The change log with the rows as they were before an action, as JSON; undoing writes them back."""
    return log.unionByName(before.select(F.lit(at).cast("bigint").alias("at"), F.lit(kind).alias("kind"), F.col("id"), F.to_json(F.struct(*before.columns)).alias("before")))


def undo(table: DataFrame, log: DataFrame, at: int) -> DataFrame:
    """The table with the rows an action of the log changed as they were before it."""
    old = log.where(F.col("at") == at).select(F.from_json("before", table.schema.simpleString()).alias("r")).select("r.*")
    return upsert(table, old, "id").select(*table.columns)


def put_value(store: DataFrame, key: str, value: str) -> DataFrame:
    """A key-value table after setting one key."""
    return upsert(store, store.sparkSession.createDataFrame([(key, value)], "key string, value string"), "key")


def interrupt_running(batches: DataFrame) -> DataFrame:
    return batches.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
