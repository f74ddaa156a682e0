"""Import of new files: known-file tests from cheap to dear, shot keys, destinations, relinking and the library check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumatable.functions import scalars as S
from lumatable.runtime import materialize

#: Files, or numbers of a name, that one task puts in order.
PART_ROWS = 100_000


def duplicate_key():
    return [F.lower("filename").alias("k_name"), F.col("size_bytes").alias("k_size"), F.col("created_at").alias("k_at")]


def pre_scan(candidates: DataFrame, library: DataFrame) -> DataFrame:
    """Candidates with `known`: by path, or by name (original name first), size and moment; letter case of names does not matter."""
    keys = library.select(F.lower(F.coalesce("original_filename", "filename")).alias("k_name"), F.col("size_bytes").alias("k_size"), F.col("created_at").alias("k_at")).where("k_at is not null").distinct().withColumn("by_key", F.lit(True))
    paths = library.select("path").distinct().withColumn("by_path", F.lit(True))
    c = candidates.withColumns({"k_name": F.lower("filename"), "k_size": F.col("size_bytes"), "k_at": F.col("created_at")})
    return c.join(keys, ["k_name", "k_size", "k_at"], "left").join(paths, "path", "left").withColumn("known", F.coalesce("by_key", "by_path", F.lit(False))).drop("k_name", "k_size", "k_at", "by_key", "by_path")


def new_by_hash(candidates: DataFrame, library: DataFrame) -> DataFrame:
    """Candidates whose content hash is new: the smallest id of each hash that the library lacks. Unread hashes stay."""
    read = candidates.where("hash is not null")
    first = read.groupBy(F.lower("hash").alias("h")).agg(F.min("id").alias("id")).join(library.select(F.lower("hash").alias("h")).distinct(), "h", "left_anti")
    return candidates.join(first.select("id"), "id", "left_semi").unionByName(candidates.where("hash is null"))


def insert_new(target: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The target after inserting rows with new hashes, and a row (inserted, duplicates)."""
    fresh = new_by_hash(rows, target)
    n, inserted = rows.count(), fresh.count()
    counts = rows.sparkSession.createDataFrame([(inserted, n - inserted)], "inserted bigint, duplicates bigint")
    return target.unionByName(fresh, allowMissingColumns=True), counts


def group_map(files: DataFrame) -> DataFrame:
    """(path, group_key): files of one directory and base stem share a key of 16 hex digits; a file alone has none."""
    keyed = files.select("path", S.directory(F.col("path")).alias("dir"), S.base_stem(F.col("path")).alias("stem"))
    several = keyed.groupBy("dir", "stem").agg(F.countDistinct("path").alias("n")).where("n > 1")
    key = F.substring(F.sha2(F.concat("dir", F.lit("\x01"), "stem"), 256), 1, 16)
    return keyed.join(several, ["dir", "stem"], "left").select("path", F.when(F.col("n").isNotNull(), key).alias("group_key")).distinct()


def _running(df: DataFrame, keys: list[str], order: list[str], value: Column, part: Column) -> DataFrame:
    """`df` with `total`, the sum of `value` up to each row in `order` within `keys`. `part` rises with the order: rows are summed within
    parts, then over the parts' sums, so that one key spreads over many tasks."""
    cut = df.withColumns({"part": part, "value": value})
    sums = cut.groupBy(*keys, "part").agg(F.sum("value").alias("total"))
    before = sums.select(*keys, "part", F.coalesce(F.sum("total").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.sum("value").over(Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cut.withColumn("total", within).join(before, [*keys, "part"]).withColumn("total", F.col("total") + F.col("before")).drop("part", "value", "before")


def _id_part(df: DataFrame, rows: int) -> Column:
    """Ranges of ids of about `rows` rows each, 256 at most; where they are cut changes no result."""
    n = min(256, -(-df.count() // rows))
    bounds = sorted(set(df.approxQuantile("id", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col("id").cast("double"))) if bounds else F.lit(0)


def plan_destinations(files: DataFrame, taken: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(id, destination): YYYY/MM/DD/name, or Unsorted/name for undated files, numbered _1, _2, ... where a name is taken.

    `taken` has the destinations in use. Files of one wanted name are served in order of id: the first gets the name itself unless it is
    taken, the others the free numbers in order. A number is free unless that name is taken or is the wanted name of another file; names
    numbered from different wanted names are never equal, so all are placed in one step, however many want the same name. An id with
    several names has a place for each. Files without an id or name are dropped.
    """
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("created_at") / 86_400).cast("int"))
    folder = F.when(F.col("created_at").isNotNull(), F.date_format(day, "yyyy/MM/dd")).otherwise("Unsorted")
    named = files.where("id is not null and filename is not null")
    named = materialize(named.select("id", F.concat(folder, F.lit("/"), S.stem(F.col("filename"))).alias("head"), F.regexp_extract("filename", r"(\.[^.]*)$", 1).alias("ext")).distinct(), "named")
    key = ["head", "ext"]
    used = taken.where("destination is not null").select("destination").distinct()
    wanted = named.groupBy(*key).agg(F.count(F.lit(1)).alias("n_files")).withColumn("destination", F.concat(*key))
    wanted = wanted.join(used.withColumn("full", F.lit(1)), "destination", "left").select(*key, "destination", "n_files", F.coalesce("full", F.lit(0)).alias("full"))

    # the numbers that are not free, of names that more than one file wants or that are taken
    split = used.unionByName(wanted.select("destination")).distinct().withColumn("ext", F.regexp_extract("destination", r"(\.[^.]*)$", 1)).withColumn("base", F.expr("left(destination, length(destination) - length(ext))"))
    split = split.withColumn("digits", F.regexp_extract("base", r"_([1-9][0-9]{0,17})\z", 1)).where("digits != ''")
    closed = split.select(F.expr("left(base, length(base) - length(digits) - 1)").alias("head"), "ext", F.col("digits").cast("bigint").alias("k")).join(wanted.where("n_files + full > 1").select(*key, "n_files"), key)
    reach = closed.groupBy(*key).agg((F.max("n_files") + F.count(F.lit(1))).alias("reach"))  # no number above it is needed
    closed = _running(closed.join(reach, key).where("k <= reach").select(*key, "k"), key, ["k"], F.lit(1), F.floor(F.col("k") / part_rows))
    closed = closed.groupBy(*key, (F.col("k") - F.col("total")).alias("pos")).agg(F.count(F.lit(1)).alias("n"))  # pos: free numbers below k

    # the file at place pos, 0 for the name itself, passes over the closed numbers with fewer free ones below them
    ranked = _running(named, key, ["id"], F.lit(1), _id_part(named, part_rows)).join(wanted.select(*key, "full"), key)
    asked = ranked.select("id", *key, (F.col("total") - 1 + F.col("full")).alias("pos"), F.lit(0).cast("bigint").alias("n"))
    both = asked.unionByName(closed.withColumn("id", F.lit(None).cast(named.schema["id"].dataType))).withColumn("closes", F.col("id").isNull())
    placed = _running(both, key, ["pos", "closes"], F.col("n"), F.floor(F.col("pos") / part_rows)).where("not closes")
    number = F.when(F.col("pos") == 0, "").otherwise(F.concat(F.lit("_"), (F.col("pos") + F.col("total")).cast("string")))
    return placed.select("id", F.concat("head", number, "ext").alias("destination"))


#: Values of a new image's columns where its file tells nothing.
DEFAULTS = {"rating": 0, "flagged": 0, "color_label": 0, "hidden": False, "missing": False, "edited": False, "has_sidecar": False, "has_xcf": False, "orientation": 1}


def with_defaults(rows: DataFrame) -> DataFrame:
    """Rows of new images with the columns they lack or leave null filled in."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in DEFAULTS.items()})


def accept(files: DataFrame, library: DataFrame, in_place: bool = False) -> DataFrame:
    """(id, outcome) of files to import (id, path, filename, size_bytes, created_at, hash), tested from cheap to dear: `empty` without
    bytes, `known` by path where files stay in place, `suspected` by name, size and moment, `duplicate` by content, of the library
    or of a file of smaller id in this import, else `new`. Unread content is new."""
    first = files.groupBy("id").agg(F.min(F.struct("path", "filename", "size_bytes", "created_at", "hash")).alias("f")).select("id", "f.*").where("id is not null")
    paths = library.select("path").where("path is not null").distinct().withColumn("by_path", F.lit(True))
    keys = library.select(F.lower(F.coalesce("original_filename", "filename")).alias("k_name"), F.col("size_bytes").alias("k_size"), F.col("created_at").alias("k_at")).where("k_at is not null").distinct().withColumn("by_key", F.lit(True))
    keyed = first.withColumns({"k_name": F.lower("filename"), "k_size": F.col("size_bytes"), "k_at": F.col("created_at")})
    cheap = materialize(keyed.join(paths, "path", "left").join(keys, ["k_name", "k_size", "k_at"], "left").select("id", F.lower("hash").alias("h"), F.when(F.col("size_bytes") <= 0, "empty").when(F.lit(in_place) & F.col("by_path"), "known").when(F.col("by_key"), "suspected").alias("outcome")), "to-read")
    read = cheap.where("outcome is null and h is not null")
    fresh = read.groupBy("h").agg(F.min("id").alias("id")).join(library.select(F.lower("hash").alias("h")).distinct(), "h", "left_anti").select("id", F.lit(True).alias("first"))
    return cheap.join(fresh, "id", "left").select("id", F.coalesce("outcome", F.when(F.col("h").isNull() | F.col("first"), "new").otherwise("duplicate")).alias("outcome"))


def import_files(library: DataFrame, batches: DataFrame, files: DataFrame, source: str, began: int, ended: int, in_place: bool = False) -> tuple[DataFrame, DataFrame]:
    """The library and the import log after an import: new files are rows with defaults, the import time and their shot's key, and the
    log's row tells how many were new, already there, or could not be taken."""
    from lumatable.operators import records

    outcome = materialize(accept(files, library, in_place), "outcome")
    n = {r.outcome: r.n for r in outcome.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}  # five kinds at most
    fresh = files.join(outcome.where("outcome = 'new'").select("id"), "id", "left_semi").dropDuplicates(["id"])
    rows = with_defaults(fresh.join(group_map(fresh).withColumnRenamed("group_key", "group_hash"), "path", "left")).withColumns({"imported_at": F.lit(began).cast("bigint"), "format": S.format_of(F.col("path"))})
    kept = [c for c in rows.columns if c in library.columns]
    log = records.start_import(batches, source, began)
    done = records.finish_import(log, records.next_id(batches), ended, n.get("new", 0), sum(n.get(k, 0) for k in ("known", "suspected", "duplicate")), n.get("empty", 0))
    return library.unionByName(rows.select(*kept), allowMissingColumns=True), done


def thumbnail_gaps(images: DataFrame, cached: DataFrame) -> DataFrame:
    """(hash, id): content without a cached thumbnail (cached: hash), each once, with the smallest id that has it."""
    return images.where("hash is not null and not coalesce(missing, false)").groupBy("hash").agg(F.min("id").alias("id")).join(cached.select("hash").distinct(), "hash", "left_anti")


def adoptable(planned: DataFrame, there: DataFrame) -> DataFrame:
    """Files whose planned place (id, destination, size_bytes, hash) already holds the same content (there: path, size_bytes, hash), so
    that nothing need be copied: length first, then content."""
    same = there.select(F.col("path").alias("destination"), "size_bytes", "hash").distinct()
    return planned.join(same, ["destination", "size_bytes", "hash"], "left_semi").select("id", "destination")


def relink(missing: DataFrame, found: DataFrame) -> DataFrame:
    """(id, path): missing files found elsewhere by name, size and content; each missing row and each found path is used once, in order."""
    key = ["k_name", "size_bytes", "hash"]
    rank = lambda by: F.row_number().over(Window.partitionBy(*key).orderBy(by))
    m = missing.select("id", F.lower("filename").alias("k_name"), "size_bytes", "hash").withColumn("rn", rank("id"))
    f = found.select("path", F.lower(F.regexp_replace("path", r"^.*/", "")).alias("k_name"), "size_bytes", "hash").distinct().withColumn("rn", rank("path"))
    return m.join(f, [*key, "rn"]).select("id", "path")


def library_check(images: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, state) where catalogue and file listing differ: missing (no file), found (marked missing but there) or new (no row)."""
    rows = images.select("path", "missing").groupBy("path").agg(F.bool_and(F.coalesce("missing", F.lit(False))).alias("marked"))
    there = listing.select("path").distinct().withColumn("there", F.lit(True))
    both = rows.join(there, "path", "full_outer")
    state = F.when(F.col("marked").isNull(), "new").when(F.col("there").isNull() & ~F.col("marked"), "missing").when(F.col("there") & F.col("marked"), "found")
    return both.select("path", state.alias("state")).where("state is not null")


def review_days(candidates: DataFrame) -> DataFrame:
    """Files and bytes by the day of their shot's earliest file; undated shots under null."""
    first = F.min("created_at").over(Window.partitionBy("shot_key"))
    return candidates.withColumn("day_number", S.day_of(first)).groupBy("day_number").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("bytes"))
