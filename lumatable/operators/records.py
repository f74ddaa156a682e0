"""Small tables beside the images: tags, albums, saved queries, date ranges, import log, edit log and presets, changed as copies.

Each function returns the table after the change. New rows take the largest id and one; these tables are small, and single
rows of them may come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumatable.operators import edits
from lumatable.plans.filters import SmartQuery, Tables


def next_id(table: DataFrame, key: str = "id") -> int:
    return (table.agg(F.max(key)).first()[0] or 0) + 1


def create(table: DataFrame, key: str = "id", **values) -> DataFrame:
    """A table with one more row; columns that are not given are null."""
    row = table.sparkSession.range(1).select(*(F.lit(next_id(table, key) if c == key else values.get(c)).cast(t).alias(c) for c, t in table.dtypes))
    return table.unionByName(row)


def update(table: DataFrame, row_id: int, key: str = "id", **values) -> DataFrame:
    hit = F.col(key) == row_id
    return table.withColumns({c: F.when(hit, F.lit(v).cast(dict(table.dtypes)[c])).otherwise(F.col(c)) for c, v in values.items()})


def delete(table: DataFrame, row_id: int, key: str = "id") -> DataFrame:
    return table.where(F.col(key) != row_id)


def get(table: DataFrame, row_id: int, key: str = "id") -> DataFrame:
    return table.where(F.col(key) == row_id)


def in_name_order(table: DataFrame) -> DataFrame:
    """All rows by name without regard to case."""
    return table.orderBy(F.lower("name"), "name")


def create_tag(tags: DataFrame, name: str) -> DataFrame:
    """Tags after making sure that one exists; a name with | or / makes its path. A blank name is an error."""
    if not name.replace("|", "").replace("/", "").strip():
        raise ValueError("a tag needs a name")
    return edits.ensure_tag_path(tags, name)


def untag_by_names(image_tags: DataFrame, tags: DataFrame, image_id: int, names: list[str]) -> DataFrame:
    """Without an image's tags of these names, whatever their case."""
    gone = tags.where(F.lower("name").isin([n.lower() for n in names])).select(F.col("id").alias("tag_id"), F.lit(image_id).cast("bigint").alias("image_id"))
    return image_tags.join(gone, ["image_id", "tag_id"], "left_anti").select(*image_tags.columns)


def add_to_album(albums: DataFrame, members: DataFrame, album_id: int, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Albums and members after adding files at the end; an album without a cover takes its first member."""
    more = edits.add_to_album(members, album_id, ids)
    return repair_covers(albums, more), more


def remove_from_album(albums: DataFrame, members: DataFrame, album_id: int, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Albums and members after removing files; an album that loses its cover takes the member of the smallest position."""
    fewer = edits.remove_from_album(members, album_id, ids)
    return repair_covers(albums, fewer), fewer


def repair_covers(albums: DataFrame, members: DataFrame) -> DataFrame:
    """Albums (album_id, cover_image_id) whose cover is a member, the one of the smallest position where it was none."""
    first = edits.album_covers(members).withColumnRenamed("cover_image_id", "first_image_id")
    kept = members.select("album_id", F.col("image_id").alias("cover_image_id"), F.lit(True).alias("is_member")).distinct()
    j = albums.join(kept, ["album_id", "cover_image_id"], "left").join(first, "album_id", "left")
    return j.withColumn("cover_image_id", F.when(F.col("is_member"), F.col("cover_image_id")).otherwise(F.col("first_image_id"))).select(*albums.columns)


def counts_of_saved(saved: DataFrame, images: DataFrame, tables: Tables) -> DataFrame:
    """(query_id, n_shots) of all saved queries (id, query_json) in one pass over the images; one that cannot be read counts 0.

    Plain conditions become one flag a query on the same scan; only queries over tags or text, which look at other tables, run apart.
    """
    spark = images.sparkSession
    parsed, broken = {}, []
    for row in saved.select("id", "query_json").collect():  # a row for each saved query
        try:
            parsed[row.id] = SmartQuery.parse(row.query_json)
        except (ValueError, TypeError):
            broken.append((row.id, 0))
    plain = {i: q for i, q in parsed.items() if not (q.tags or q.not_tags or q.text)}
    held = F.array_compact(F.array(*(F.when(q.condition(), F.lit(i).cast("bigint")) for i, q in plain.items()))) if plain else F.array().cast("array<bigint>")
    counted = images.select(F.explode(held).alias("query_id"), "shot_key").groupBy("query_id").agg(F.countDistinct("shot_key").alias("n_shots"))
    for i, q in parsed.items():
        if i not in plain:
            counted = counted.unionByName(q.apply(images, tables).agg(F.lit(i).cast("bigint").alias("query_id"), F.countDistinct("shot_key").alias("n_shots")))
    every = spark.createDataFrame([(i,) for i in parsed] + [(i,) for i, _ in broken], "query_id bigint")
    return every.join(counted, "query_id", "left").select("query_id", F.coalesce("n_shots", F.lit(0)).alias("n_shots"))


def start_import(batches: DataFrame, source: str, at: int) -> DataFrame:
    """The import log with a running batch."""
    return create(batches, source=source, started_at=at, status="running")


def finish_import(batches: DataFrame, batch_id: int, at: int, imported: int, duplicates: int, errors: int) -> DataFrame:
    """A batch with errors and no new file has failed; any other is complete."""
    return update(batches, batch_id, finished_at=at, imported=imported, duplicates=duplicates, errors=errors, status="failed" if errors and not imported else "complete")


def running_imports(batches: DataFrame) -> DataFrame:
    return batches.where(F.col("status") == "running")


def record_edit(log: DataFrame, image_id: int, tool: str, at: int, sidecar: str | None = None) -> DataFrame:
    return create(log, image_id=image_id, tool_name=tool, edited_at=at, sidecar_path=sidecar)


def edit_history(log: DataFrame, image_id: int) -> DataFrame:
    """An image's edits, newest first."""
    return log.where(F.col("image_id") == image_id).orderBy(F.desc("edited_at"), F.desc("id"))


def save_preset(presets: DataFrame, name: str, value: str) -> DataFrame:
    return edits.upsert(presets, presets.sparkSession.createDataFrame([(name, value)], "name string, value string"), "name")


def keep_newest(log: DataFrame, most: int = 50) -> DataFrame:
    """A change log (at) with its newest actions only."""
    actions = log.select("at").distinct().orderBy(F.desc("at")).limit(most)
    return log.join(actions, "at", "left_semi")


def put_rows(table: DataFrame, rows: DataFrame, key: str = "image_id", **constants) -> DataFrame:
    """Update columns of the images by key: thumbhashes, titles, descriptions, sidecar and edit flags, or paths of files found again."""
    changes = rows.select(key, *(c for c in rows.columns if c in table.columns and c != key), *(F.lit(v).alias(c) for c, v in constants.items()))
    return edits.set_values(table, changes.withColumnRenamed(key, "id") if key != "id" else changes)


def numbered(rows: DataFrame, order: list, start: int = 1) -> DataFrame:
    """Rows with `id` in an order, for small lists that are shown by number."""
    return rows.withColumn("id", F.row_number().over(Window.orderBy(*order)) + start - 1)
