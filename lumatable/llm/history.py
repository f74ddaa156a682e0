"""New batches checked for duplicates against everything accepted before, without reprocessing the history.

Accepted records live in sorted runs in a folder of the shared file system, which any later application can open again. A record
has two sort keys: its content hash, and its time with its size class and cleaned name; in the order of each key possible repeats
are neighbours. A run is cut into files at places of the sort keys, and a manifest holds the first and last place of every file. A
batch is sorted into a run of its own; then only those files are read in which a window around one of its records lies, so
a batch costs files for its own records, however long the history is. Runs of like size are merged when they become many, so
a record is rewritten as often as the logarithm of the history. Equal records are kept once in a run, with their
smallest id, so that no group of copies, however large, is expanded into pairs.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumatable.functions.instants import number_us
from lumatable.functions.text import strip_space
from lumatable.runtime import drop_path, materialize, release, scratch_path, ship, table

#: Seconds and share of the larger size by which records of equal names may differ.
SECONDS, SIZE_PERCENT = 2, 1
#: Width of the time slots and size classes of the second sort key; a record looks into a neighbour only where it lies near its edge.
SLOT_S, SIZE_FACTOR = 30, 1.25
#: Rows of a file at least, files a run is cut into at most, runs of like size that are kept, and by what factor sizes are alike.
FILE_ROWS, MOST_FILES, MOST_RUNS, TIER = 50_000, 10_000, 4, 4
#: Records of waiting batches that are checked at once, and window rows of them that may be broadcast; more are joined by a shuffle.
STEP_ROWS, WINDOW_ROWS = 100_000, 300_000

# Words that copying adds to a file's name.
COPY_WORDS = ("copy", "copie", "kopie", "copia", "kopia", "cópia", "kopi", "kopio", "コピー", "副本", "копия")
_WORD = "|".join(COPY_WORDS)
_COPY = re.compile(rf"(?:\s*\((?:\d{{1,3}}|{_WORD})\)|(?:\s*-\s*|[\s_]+)(?:{_WORD})(?:[\s_-]*\(?\d{{1,3}}\)?)?|\s*~\d{{1,3}}|[_-]\d{{1,2}})$")
_SPELLINGS = {"jpeg": "jpg", "tiff": "tif"}


def clean_name(name: str | None) -> str | None:
    """A file name without what copying and respelling change: letter case, Unicode form, jpeg and tiff, one copy mark or number.

    A number joined by `_` or `-` is a copy mark only where it has at most two digits and the rest still holds a digit, so that
    camera counters stay. Edit suffixes stay. Null and blank names give None.
    """
    if name is None or not (text := unicodedata.normalize("NFC", unicodedata.normalize("NFC", name.strip()).casefold())):
        return None
    stem, dot, extension = text.rpartition(".")
    if not dot:
        stem, extension = extension, ""
    cut = _COPY.search(stem)
    if cut and (rest := stem[: cut.start()].rstrip()) and (stem[cut.start()] not in "_-" or not cut.group().lstrip("_-").isdigit() or any(c.isdigit() for c in rest)):
        stem = rest
    extension = extension.strip()
    return f"{stem}.{_SPELLINGS.get(extension, extension)}"


@F.pandas_udf(T.StringType())
def _clean_names(names: pd.Series) -> pd.Series:
    return names.map(clean_name, na_action="ignore")


def records(df: DataFrame, record_id: str, content_hash: str, name: Column, size: str, created: str) -> DataFrame:
    """Records (id, hash, name, t, size) of a table, cleaned; rows without an id are dropped."""
    h = F.lower(strip_space(F.col(content_hash)))
    raw = df.select(F.col(record_id).cast("bigint").alias("id"), F.when(h != "", h).alias("hash"), name.alias("name"), F.floor(number_us(created) / 1_000_000).alias("t"), F.col(size).cast("bigint").alias("size"))
    return raw.where("id is not null").withColumn("name", _clean_names("name"))


def _slot(t: Column) -> Column:
    return F.floor(t / SLOT_S)


def _size_class(size: Column) -> Column:
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / math.log(SIZE_FACTOR))


def _place(slot: Column, size_class: Column) -> Column:
    """The place of a record in the order of the second key: records of one moment stand together, whatever batch they came with."""
    return F.concat(F.lit("n"), F.lpad(slot.cast("string"), 12, "0"), F.lit("/"), F.lpad(size_class.cast("string"), 4, "0"), F.lit("/"), F.col("name"))


_NAMED = "name is not null and t is not null and size is not null"


def _keyed(recs: DataFrame) -> DataFrame:
    """Rows (place, t, size, id): one for a record's hash, one for its name, time and size."""
    none = F.lit(None).cast("bigint")
    by_hash = recs.where("hash is not null").select(F.concat(F.lit("h"), "hash").alias("place"), none.alias("t"), none.alias("size"), "id")
    return by_hash.unionByName(recs.where(_NAMED).select(_place(_slot(F.col("t")), _size_class(F.col("size"))).alias("place"), "t", "size", "id"))


def _windows(recs: DataFrame) -> DataFrame:
    """Rows (p_place, p_t, p_size, repeat_id): all places at which what a record repeats can stand. Mostly one or two a record."""
    none = F.lit(None).cast("bigint")
    by_hash = recs.where("hash is not null").select(F.concat(F.lit("h"), "hash").alias("p_place"), none.alias("p_t"), none.alias("p_size"), F.col("id").alias("repeat_id"))
    span = lambda low, high: F.explode(F.sequence(low, high))
    t, size = F.col("t"), F.col("size")
    near = recs.where(_NAMED).select("id", "name", "t", "size", span(_slot(t - SECONDS), _slot(t + SECONDS)).alias("slot"))
    # a little wider than the percentage asks, against rounding
    near = near.select("*", span(_size_class(F.floor(size * (1 - SIZE_PERCENT / 100) - 1)), _size_class(F.ceil(size / (1 - SIZE_PERCENT / 100) + 1))).alias("size_class"))
    return by_hash.unionByName(near.select(_place(F.col("slot"), F.col("size_class")).alias("p_place"), F.col("t").alias("p_t"), F.col("size").alias("p_size"), F.col("id").alias("repeat_id")))


@dataclass(frozen=True)
class RunFile:
    """A file of a run, with its first and last place and its rows, as the manifest has it."""

    run: str
    path: str
    first: str
    last: str
    n: int


class SortedRuns:
    """The accepted records as sorted runs below a folder of the shared file system; one writer at a time.

    Each change writes new runs first, then a new manifest in one file, and deletes what it replaced last, so whoever opens
    the folder after a failure finds the state before or after the change.
    """

    ROWS = "place string, t bigint, size bigint, id bigint"
    MANIFEST = "version bigint, run string, path string, first string, last string, n bigint"

    def __init__(self, spark: SparkSession, folder: str, file_rows: int = FILE_ROWS):
        self.spark, self.folder, self.file_rows = spark, folder.rstrip("/"), file_rows
        self.version, self.files, self.rows_read, self.rows_written = 0, [], 0, 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str, file_rows: int = FILE_ROWS) -> SortedRuns:
        """The history that this or another application left in the folder."""
        store = cls(spark, folder, file_rows)
        every = spark.read.schema(cls.MANIFEST).json(f"{store.folder}/manifest-*")
        store.version = every.agg(F.max("version")).first()[0]
        last = every.where(F.col("version") == store.version).where("path is not null").drop("version").orderBy("run", "first").collect()  # a row for each file
        store.files = [RunFile(**r.asDict()) for r in last]
        return store

    @property
    def runs(self) -> dict[str, list[RunFile]]:
        out = defaultdict(list)
        for f in self.files:
            out[f.run].append(f)
        return dict(out)

    def _write(self, keyed: DataFrame) -> list[RunFile]:
        """A new run of equal records put together, sorted, and cut into files of bounded size."""
        kept = materialize(keyed.groupBy("place", "t", "size").agg(F.min("id").alias("id")), "collapsed")
        total = kept.count()
        if not total:
            release(kept)
            return []
        rows = max(self.file_rows, -(-total // MOST_FILES))
        run = f"run-{uuid.uuid4().hex}"
        kept.repartitionByRange(-(-total // rows), "place").sortWithinPartitions("place", "t", "size").write.option("compression", "zstd").parquet(f"{self.folder}/{run}")
        self.rows_written += total
        release(kept)
        ends = self.spark.read.schema(self.ROWS).parquet(f"{self.folder}/{run}").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count(F.lit(1)).alias("n"))
        return sorted((RunFile(run, r.path, r["first"], r["last"], r.n) for r in ends.collect()), key=lambda f: f.first)  # a row for each file

    def _commit(self, files: list[RunFile]) -> None:
        gone = {f.run for f in self.files} - {f.run for f in files}
        rows = [(self.version + 1, f.run, f.path, f.first, f.last, f.n) for f in files] or [(self.version + 1, *[None] * 5)]
        self.spark.createDataFrame(rows, self.MANIFEST).coalesce(1).write.json(f"{self.folder}/manifest-{self.version + 1:08d}")
        if self.version:
            drop_path(self.spark, f"{self.folder}/manifest-{self.version:08d}")
        self.version, self.files = self.version + 1, files
        for run in gone:
            drop_path(self.spark, f"{self.folder}/{run}")

    def _alike(self, files: list[RunFile]) -> set[str]:
        """Runs to merge: those of one size tier, where it has become full."""
        sizes, tiers = defaultdict(int), defaultdict(set)
        for f in files:
            sizes[f.run] += f.n
        for run, n in sizes.items():
            tiers[max(0, int(math.log(n / self.file_rows, TIER))) if n > self.file_rows else 0].add(run)
        return next((runs for _, runs in sorted(tiers.items()) if len(runs) >= MOST_RUNS), set())

    def merge(self, recs: DataFrame) -> None:
        """Accept records: sort them into a run of their own, and merge runs of like size where they have become many."""
        files = self.files + self._write(_keyed(recs))
        while alike := self._alike(files):
            old = self.spark.read.schema(self.ROWS).parquet(*(f.path for f in files if f.run in alike))
            fresh = self._write(old)
            gone = [f.run for f in files if f.run in alike and f not in self.files]
            files = [f for f in files if f.run not in alike] + fresh
            for run in set(gone):  # written by this call, in no manifest
                drop_path(self.spark, f"{self.folder}/{run}")
        self._commit(files)

    def touched(self, windows: DataFrame) -> list[RunFile]:
        """The files in which a place of the windows (p_place) can stand: one search in each run's bounds for each window."""
        ship(self.spark)
        runs = [(([f.first for f in files]), [f.last for f in files], [self.files.index(f) for f in files]) for files in self.runs.values()]
        sent = self.spark.sparkContext.broadcast(runs)  # two places a file

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hit: set[int] = set()
            for b in batches:
                for p in b.p_place:
                    for firsts, lasts, numbers in sent.value:
                        i = bisect_right(firsts, p) - 1
                        if i >= 0 and p <= lasts[i]:
                            hit.add(numbers[i])
            yield pd.DataFrame({"file": np.fromiter(hit, dtype="int64")})

        return [self.files[r.file] for r in windows.select("p_place").mapInPandas(search, "file bigint").distinct().collect()]  # a row for each file

    def check(self, batch: DataFrame, window_rows: int = WINDOW_ROWS) -> DataFrame:
        """(first_id, repeat_id) of the batch's records that repeat an accepted record of smaller id; first_id is the smallest one."""
        windows = materialize(_windows(batch), "windows")
        files = self.touched(windows)
        if not files:
            return self.spark.createDataFrame([], "first_id bigint, repeat_id bigint")
        self.rows_read += sum(f.n for f in files)
        near = self.spark.read.schema(self.ROWS).parquet(*(f.path for f in files))
        if windows.limit(window_rows + 1).count() <= window_rows:
            windows = F.broadcast(windows)
        close = F.col("t").isNull() | ((F.abs(F.col("t") - F.col("p_t")) <= SECONDS) & (F.abs(F.col("size") - F.col("p_size")) * 100 <= F.greatest("size", "p_size") * SIZE_PERCENT))
        pairs = near.join(windows, F.col("place") == F.col("p_place")).where(close & (F.col("id") < F.col("repeat_id")))
        return pairs.groupBy("repeat_id").agg(F.min("id").alias("first_id")).select("first_id", "repeat_id")


def steps_of(batches: list[tuple[int, int]], rows: int) -> list[tuple[int, int]]:
    """First and last batch of each step: consecutive batches put together while they have at most `rows` rows."""
    out: list[list[int]] = []
    held = 0
    for batch, n in sorted(batches):
        if not out or held + n > rows:
            out.append([batch, batch])
            held = 0
        out[-1][1], held = batch, held + n
    return [(a, b) for a, b in out]


def id_bounds(arrived: DataFrame, rows: int) -> list[int]:
    """Last ids of ranges of candidate_id that have about half of `rows` rows each; the last range is open. Where they are cut changes no result."""
    n = -(-2 * arrived.count() // rows)
    return sorted({int(x) for x in arrived.approxQuantile("candidate_id", [i / n for i in range(1, n)], 1 / (4 * n))}) if n > 1 else []


def found(spark: SparkSession, sf_dir: str, step_rows: int = STEP_ROWS) -> DataFrame:
    """Query p5_found: the candidates that repeat an image or a candidate of smaller id.

    Waiting candidates are taken in steps of rising ids, whatever batch they came with; each step is accepted before it is checked, so
    all smaller ids are there. Ids keep the order within a step. Results are the same for every size of the steps. The history is
    made of the images here, as these tables come without one, and deleted at the end; SortedRuns.open continues one that was kept.
    """
    ship(spark)
    images = table(spark, sf_dir, "images").select("id", "hash", "original_filename", "filename", "size_bytes", "created_at")
    store = SortedRuns(spark, scratch_path(spark, "history"))
    store.merge(records(images, "id", "hash", F.coalesce("original_filename", "filename"), "size_bytes", "created_at"))
    arrived = table(spark, sf_dir, "import_candidates").select(F.col("candidate_id").cast("bigint").alias("candidate_id"), "filename", "size_bytes", "created_at", "hash").where("candidate_id is not null")
    out = check_waiting(store, arrived, step_rows)
    drop_path(spark, store.folder)
    return out


def check_waiting(store: SortedRuns, arrived: DataFrame, step_rows: int = STEP_ROWS) -> DataFrame:
    """(first_id, repeat_id) of waiting candidates (candidate_id, filename, size_bytes, created_at, hash) that repeat an accepted
    record or a candidate of smaller id; all of them are accepted."""
    spark, results = store.spark, scratch_path(store.spark, "repeats")
    bounds = id_bounds(arrived, step_rows)

    @F.pandas_udf(T.IntegerType())
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, dtype=np.int64), ids.to_numpy()).astype("int32"))

    ranges = [(r.id_range, r.n) for r in arrived.groupBy(range_of("candidate_id").alias("id_range")).agg(F.count(F.lit(1)).alias("n")).collect()]  # a row for each range
    for first, last in steps_of(ranges, step_rows):
        step = arrived
        if first > 0:
            step = step.where(F.col("candidate_id") > bounds[first - 1])
        if last < len(bounds):
            step = step.where(F.col("candidate_id") <= bounds[last])
        batch = materialize(records(step, "candidate_id", "hash", F.col("filename"), "size_bytes", "created_at").distinct(), "batch")
        store.merge(batch)
        store.check(batch).write.mode("append").parquet(results)
        release(batch)
    schema = "first_id bigint, repeat_id bigint"
    return spark.read.schema(schema).parquet(results) if ranges else spark.createDataFrame([], schema)


def _sql() -> str:
    from lumatable.plans.catalog import _seconds_sql

    clean = f"""SELECT *, CASE WHEN cut <> '' AND rest <> '' AND (left(cut, 1) NOT IN ('_', '-') OR NOT regexp_matches(ltrim(cut, '_-'), '^[0-9]+$') OR regexp_matches(rest, '[0-9]')) THEN rest ELSE stem END || '.' || CASE ext WHEN 'jpeg' THEN 'jpg' WHEN 'tiff' THEN 'tif' ELSE ext END AS key
FROM (SELECT *, rtrim(left(stem, length(stem) - length(cut))) AS rest FROM (SELECT *, regexp_extract(stem, '{_COPY.pattern}', 0) AS cut FROM
(SELECT *, CASE WHEN contains(n, '.') THEN regexp_extract(n, '^(.*)\\.[^.]*$', 1, 's') ELSE n END AS stem, CASE WHEN contains(n, '.') THEN trim(regexp_extract(n, '\\.([^.]*)$', 1, 's')) ELSE '' END AS ext FROM
(SELECT *, nullif(lower(nfc_normalize(trim(name))), '') AS n FROM rec))))"""
    return f"""
WITH rec AS (SELECT DISTINCT id, nullif(lower(trim(hash)), '') AS h, coalesce(original_filename, filename) AS name, size_bytes AS size, CAST({_seconds_sql('created_at')} AS BIGINT) AS t, false AS waits FROM images WHERE id IS NOT NULL
  UNION ALL SELECT DISTINCT candidate_id, nullif(lower(trim(hash)), ''), filename, size_bytes, CAST({_seconds_sql('created_at')} AS BIGINT), true FROM import_candidates WHERE candidate_id IS NOT NULL),
k AS ({clean}),
p AS (SELECT a.id AS first_id, b.id AS repeat_id FROM k a JOIN k b ON a.h = b.h AND a.id < b.id WHERE b.waits
  UNION ALL SELECT a.id, b.id FROM k a JOIN k b ON a.key = b.key AND a.id < b.id AND abs(a.t - b.t) <= {SECONDS} AND abs(a.size - b.size) * 100 <= greatest(a.size, b.size) * {SIZE_PERCENT} WHERE b.waits)
SELECT min(first_id) AS first_id, repeat_id FROM p GROUP BY repeat_id"""


SQL = {"p5_found": _sql}
