"""Sources of files to import: folders, fixed lists, and the databases of other photo managers."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatable.functions import scalars as S


class Source(Protocol):
    """Something that yields paths to import, and may know more about them."""

    source_type: str

    def scan(self) -> DataFrame: ...

    def description(self) -> str: ...


def supported(df: DataFrame, path: str = "path") -> DataFrame:
    return df.where(S.extension(F.col(path)).isin(*S.FORMATS))


def existing(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """Paths of another manager's database that are among the files there (path)."""
    return paths.join(listing.select("path").distinct(), "path", "left_semi")


def apply_metadata(images: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images after taking over what another manager knows (path, rating, flagged, tags): values it has replace those here, and silence
    keeps them; and (image_id, tag_path) of the tags to add."""
    one = known.groupBy("path").agg(*(F.max(c).alias(f"__{c}") for c in ("rating", "flagged")), F.array_distinct(F.flatten(F.collect_list("tags"))).alias("__tags"))
    j = images.join(one, "path", "left")
    tags = j.select(F.col("id").alias("image_id"), F.explode("__tags").alias("tag_path"))
    return j.withColumns({c: F.coalesce(f"__{c}", c) for c in ("rating", "flagged")}).select(*images.columns), tags


class FolderSource:
    """Files of the known kinds below a folder, or only directly in it; content is not read unless asked for."""

    source_type = "disk"

    def __init__(self, spark: SparkSession, root: str, recursive: bool = True):
        self.spark, self.root, self.recursive = spark, root, recursive

    def description(self) -> str:
        return self.root

    def scan(self, content: bool = False) -> DataFrame:
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", str(self.recursive).lower()).load(self.root)
        plain = files.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
        cols = ["path", "length", F.unix_timestamp("modificationTime").alias("mtime"), *(["content"] if content else [])]
        return supported(plain.select(*cols)).withColumn("format", S.format_of(F.col("path")))


class ListSource:
    source_type = "list"

    def __init__(self, spark: SparkSession, paths: list[str]):
        self.spark, self.paths = spark, paths

    def description(self) -> str:
        return f"{len(self.paths)} files"

    def scan(self) -> DataFrame:
        return self.spark.createDataFrame([(p,) for p in self.paths], "path string")


def read_sqlite(spark: SparkSession, database: str, query: str, schema: str) -> DataFrame:
    """Rows of a query on an SQLite file, read by one task of the cluster in batches; the file must be on shared storage."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            with sqlite3.connect(f"file:{database}?mode=ro", uri=True) as con:
                cursor = con.execute(query)
                while rows := cursor.fetchmany(10_000):
                    yield pd.DataFrame(rows, columns=names)

    return spark.range(1).repartition(1).mapInPandas(run, schema)


class ShotwellSource:
    """Paths and tags of a Shotwell database, newest exposure first."""

    source_type = "shotwell"

    def __init__(self, spark: SparkSession, database: str):
        self.spark, self.database = spark, database

    def description(self) -> str:
        return self.database

    def scan(self) -> DataFrame:
        return supported(read_sqlite(self.spark, self.database, "SELECT filename, exposure_time FROM PhotoTable", "path string, exposure_time bigint")).orderBy(F.desc("exposure_time")).select("path")

    def tags(self) -> DataFrame:
        """(path, name): a tag keeps its photos as a list of hexadecimal ids, which is exploded and joined."""
        tags = read_sqlite(self.spark, self.database, "SELECT name, photo_id_list FROM TagTable", "name string, ids string")
        photos = read_sqlite(self.spark, self.database, "SELECT id, filename FROM PhotoTable", "id bigint, path string")
        listed = tags.select("name", F.explode(F.split("ids", ",")).alias("t")).where(F.col("t").startswith("thumb"))
        return listed.select("name", F.conv(F.substring("t", 6, 16), 16, 10).cast("bigint").alias("id")).join(photos, "id").select("path", "name").distinct()


class DigikamSource:
    """Paths, ratings, pick labels and tag paths of a digiKam database."""

    source_type = "digikam"

    def __init__(self, spark: SparkSession, database: str, volumes: dict[str, str] | None = None):
        """`volumes` gives the folder at which each volume, by its UUID, is to be found."""
        self.spark, self.database, self.volumes = spark, database, volumes or {}

    def description(self) -> str:
        return self.database

    def _photos(self) -> DataFrame:
        q = "SELECT i.id, r.identifier, r.specificPath, a.relativePath, i.name FROM Images i JOIN Albums a ON i.album = a.id JOIN AlbumRoots r ON a.albumRoot = r.id WHERE i.status = 1"
        rows = read_sqlite(self.spark, self.database, q, "id bigint, identifier string, root string, folder string, name string")
        return rows.select("id", F.regexp_replace(F.concat_ws("/", self._volume(F.col("identifier")), F.coalesce("root", F.lit("")), "folder", "name"), "/+", "/").alias("path"))

    def _volume(self, identifier: Column) -> Column:
        """Where a root begins: the path that its identifier names, else the folder of its volume, else the file system's root."""
        part = lambda key: S.percent_decode(F.regexp_extract(identifier, rf"[?&]{key}=([^&]*)", 1))
        known = F.create_map(*(F.lit(x) for kv in self.volumes.items() for x in kv)) if self.volumes else F.create_map().cast("map<string,string>")
        return F.coalesce(F.when(part("path") != "", part("path")), F.try_element_at(known, F.lower(part("uuid"))), F.lit(""))

    def scan(self) -> DataFrame:
        return supported(self._photos().select("path"))

    def metadata(self) -> DataFrame:
        """(path, rating, flagged, tags): ratings at most 5 and null below 0; pick label 1 rejects, 3 picks; the manager's own tags are left out."""
        info = read_sqlite(self.spark, self.database, "SELECT imageid, rating FROM ImageInformation", "id bigint, rating int")
        tags = read_sqlite(self.spark, self.database, "WITH RECURSIVE p(id, path, root) AS (SELECT id, name, name FROM Tags WHERE pid = 0 UNION ALL SELECT t.id, p.path || '|' || t.name, p.root FROM Tags t JOIN p ON t.pid = p.id LIMIT 1000000) SELECT it.imageid, p.path, p.root FROM ImageTags it JOIN p ON it.tagid = p.id", "id bigint, tag string, root string")
        own = F.col("root") == "_Digikam_Internal_Tags_"
        pick = F.regexp_extract("tag", r"^_Digikam_Internal_Tags_\|Pick Label (\w+)", 1)
        each = tags.groupBy("id").agg(F.collect_set(F.when(~own, F.col("tag"))).alias("tags"), F.max(F.when(own & (pick == "Rejected"), -1).when(own & (pick == "Accepted"), 1)).alias("flagged"))
        rating = F.when(F.col("rating") >= 0, F.least(F.col("rating"), F.lit(5)))
        return self._photos().join(info, "id", "left").join(each, "id", "left").select("path", rating.alias("rating"), "flagged", F.sort_array(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"))
