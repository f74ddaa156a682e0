"""Snapshots of catalogue tables: written whole, checked, kept in a number of newest ones, mirrored and read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumatable.runtime import drop_path, path_exists

#: Snapshots kept, and seconds after which a new one is due.
KEEP, EVERY_S = 14, 20 * 3_600


def snapshot(tables: dict[str, DataFrame], folder: str, at: int) -> None:
    """Write all tables as snapshot `at`. Its list of tables and rows is written last, so a snapshot without one was not finished and
    does not count. A table whose rows differ when read back is an error."""
    spark = next(iter(tables.values())).sparkSession
    place = f"{folder}/snapshot-{at}"
    rows = []
    for name, df in sorted(tables.items()):
        df.write.mode("overwrite").parquet(f"{place}/{name}")
        check = F.bit_xor(F.xxhash64(*df.columns))
        want, got = (t.agg(F.count(F.lit(1)), check).first() for t in (df, spark.read.schema(df.schema).parquet(f"{place}/{name}")))
        if want != got:
            raise OSError(f"table {name} of snapshot {at} does not read back as it was written")
        rows.append((at, name, want[0], df.schema.json()))
    spark.createDataFrame(rows, "at bigint, name string, n_rows bigint, columns string").coalesce(1).write.mode("overwrite").json(f"{place}/tables")


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(at, name, n_rows, columns) of the finished snapshots' tables."""
    schema = "at bigint, name string, n_rows bigint, columns string"
    if not path_exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(folder)


def is_due(spark: SparkSession, folder: str, now: int) -> bool:
    last = snapshots(spark, folder).agg(F.max("at")).first()[0]
    return last is None or now - last >= EVERY_S


def rotate(spark: SparkSession, folder: str, keep: int = KEEP) -> list[int]:
    """Delete all but the newest snapshots; gives what was deleted."""
    held = sorted((r.at for r in snapshots(spark, folder).select("at").distinct().collect()), reverse=True)  # a number for each snapshot
    for at in held[keep:]:
        drop_path(spark, f"{folder}/snapshot-{at}")
    return held[keep:]


def restore(spark: SparkSession, folder: str, at: int | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot, of the newest where none is given."""
    every = snapshots(spark, folder)
    at = every.agg(F.max("at")).first()[0] if at is None else at
    found = every.where(F.col("at") == at).collect()  # a row for each table
    if not found:
        raise FileNotFoundError(f"no finished snapshot {at} in {folder}")
    return {r.name: spark.read.schema(StructType.fromJson(json.loads(r.columns))).parquet(f"{folder}/snapshot-{at}/{r.name}") for r in found}


def mirror(spark: SparkSession, folder: str, other: str) -> list[int]:
    """Copy the snapshots that another folder lacks; gives what was copied."""
    numbers = lambda f: {r.at for r in snapshots(spark, f).select("at").distinct().collect()}
    missing = sorted(numbers(folder) - numbers(other))
    for at in missing:
        snapshot(restore(spark, folder, at), other, at)
    return missing
