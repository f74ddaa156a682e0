"""The best record of each group of duplicates, chosen field by field.

Members are ranked by recency with window ordering; a field takes the value of the first member that has it set, so incomplete
or untrusted values fall through to older members. Ranking runs in two steps, within parts of a group and then over the
parts' survivors, so that a group with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumatable.functions.text import strip_space
from lumatable.runtime import table

#: Parts a group is cut into for the first ranking.
PARTS = 32


def survivors(members: DataFrame, key: str, member_id: str, order: list[Column], fields: dict[str, Column], parts: int = PARTS) -> DataFrame:
    """(key, n_members, a column for each of `fields`): of each group, each field's value in the first member that has it set.

    `fields` gives, by name, the value where set and null where not; `order` ranks members, ties go to the larger id. A field
    that no member has set is null. n_members counts distinct ids. Rows without key or id are dropped; repeated rows count
    once. An empty table gives no rows.
    """
    slim = members.select(
        F.col(key).alias("__key"), F.col(member_id).alias("__id"), F.struct(*(v.alias(k) for k, v in fields.items())).alias("__v"), *(o.alias(f"__o{i}") for i, o in enumerate(order))
    ).where("__key is not null and __id is not null")
    # larger ranks first; nulls rank last
    ranks = [F.desc_nulls_last(f"__o{i}") for i in range(len(order))] + [F.desc("__id"), *(F.desc_nulls_last(f"__v.{k}") for k in fields)]
    salted = slim.withColumn("__part", F.pmod(F.xxhash64("__id"), F.lit(parts)).cast("int")).repartition("__key", "__part")
    w = Window.partitionBy("__key", "__part").orderBy(*ranks)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.struct(*(F.col(f"__o{i}").alias(f"o{i}") for i in range(len(order))), F.col("__id").alias("id"))
    first = {k: F.first(F.when(F.col(f"__v.{k}").isNotNull(), F.struct(rank.alias("rank"), F.col(f"__v.{k}").alias("value"))), ignorenulls=True).over(whole) for k in fields}
    same_as_before = F.coalesce(F.lag("__id").over(w) == F.col("__id"), F.lit(False))
    # copies of a row are neighbours in this order; the id decides the part, so parts share no id
    ranked = salted.withColumns({"__n": F.when(same_as_before, 0).otherwise(1), "__first": F.row_number().over(w) == 1} | first)
    best = ranked.groupBy("__key", "__part").agg(F.sum("__n").alias("n"), *(F.max(F.when(F.col("__first"), F.col(k))).alias(k) for k in fields))
    across = Window.partitionBy("__key")
    out = best.withColumn("n_members", F.sum("n").over(across))
    for k in fields:
        by = [F.desc_nulls_last(f"{k}.rank.o{i}") for i in range(len(order))] + [F.desc_nulls_last(f"{k}.rank.id")]
        out = out.withColumn(f"__{k}", F.first(F.when(F.col(k).isNotNull(), F.col(f"{k}.value")), ignorenulls=True).over(across.orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return out.withColumn("__one", F.row_number().over(across.orderBy("__part"))).where("__one = 1").select(F.col("__key").alias(key), "n_members", *(F.col(f"__{k}").alias(k) for k in fields))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query p6_found: one record of rating, flag and colour of each shot with at least two images."""
    images = table(spark, sf_dir, "images").select("id", F.lower(strip_space(F.col("group_hash"))).alias("group_hash"), "xmp_mtime", "imported_at", "rating", "flagged", "color_label")
    fields = {"rating": F.when(F.col("rating").between(1, 5), F.col("rating")), "flagged": F.when(F.col("flagged").isin(-1, 1), F.col("flagged")), "color_label": F.when(F.col("color_label").between(1, 5), F.col("color_label"))}
    best = survivors(images.where("group_hash != ''"), "group_hash", "id", [F.col("xmp_mtime"), F.col("imported_at")], fields)
    return best.where("n_members >= 2").select("group_hash", *(F.coalesce(k, F.lit(0)).cast("int").alias(k) for k in fields))


def _sql() -> str:
    order = "xmp_mtime DESC NULLS LAST, imported_at DESC NULLS LAST, id DESC"
    first = lambda f, cond: f"coalesce(first({f} ORDER BY {order}) FILTER (WHERE {cond}), 0)::INTEGER AS {f}"
    return f"""
WITH m AS (SELECT DISTINCT id, lower(trim(group_hash)) AS group_hash, xmp_mtime, imported_at, rating, flagged, color_label FROM images WHERE id IS NOT NULL AND trim(group_hash) != '')
SELECT group_hash, {first('rating', 'rating BETWEEN 1 AND 5')}, {first('flagged', 'flagged IN (-1, 1)')}, {first('color_label', 'color_label BETWEEN 1 AND 5')}
FROM m GROUP BY group_hash HAVING count(DISTINCT id) >= 2"""


SQL = {"p6_found": _sql}
