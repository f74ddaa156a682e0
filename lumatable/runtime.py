"""Session-level helpers: table access, shared scratch space, checked broadcasts and salting."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a relation may be broadcast after its rows were counted.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a Spark application; to be called before Python functions run there."""
    context = spark.sparkContext
    if getattr(context, "_lumatable_shipped", None) == context.applicationId:
        return
    root, folder = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="lumatable-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/lumatable_code.zip", "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(f"{folder}/lumatable_code.zip")
    context._lumatable_shipped = context.applicationId


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only in local mode, where driver and executors are one process, an unset
    one is replaced by a temporary folder; on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = getattr(spark, "_lumatable_scratch", None)
        if root is None:
            root = tempfile.mkdtemp(prefix="lumatable-")
            atexit.register(shutil.rmtree, root, True)
            spark._lumatable_scratch = root
    return root.rstrip("/")


#: Scratch paths of this process that still are to be deleted, with a function that does it.
_LIVING: dict[str, object] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; deleted with release or drop_path, at the latest when the application ends."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    if not _LIVING:
        atexit.register(_drop_all)
    _LIVING[path] = spark._jvm
    return path


def _drop_all() -> None:
    for path, jvm in list(_LIVING.items()):
        try:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)
        except Exception:  # noqa: BLE001  the JVM has gone before
            return
    _LIVING.clear()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, which cuts the lineage and survives the loss of executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._lumatable_path = path
    return back


def release(*frames: DataFrame) -> None:
    """Delete what materialize wrote for these frames, once nothing reads them any more."""
    for df in frames:
        if path := df.__dict__.pop("_lumatable_path", None):
            drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _LIVING.pop(path, None)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


class Rounds:
    """Tables of an iteration: keeps what each round writes, and deletes rounds no longer needed."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.old = spark, label, []

    def keep(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        path = scratch_path(self.spark, self.label)
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
        self.old.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, but: int = 0) -> None:
        """Delete all but the last `but` tables."""
        cut = len(self.old) - but
        for path in self.old[:cut]:
            drop_path(self.spark, path)
        self.old = self.old[cut:]


def spread(df: DataFrame) -> DataFrame:
    """`df` over as many tasks as there are cores, for costly Python work on a few small files; inputs of enough splits stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def broadcast_within(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """`df` with a broadcast hint where a count proves it has at most `rows` rows; else as it is, for a shuffled join."""
    small = df.limit(rows + 1).count() <= rows
    return (F.broadcast(df) if small else df), small


def salted_lookup(facts: DataFrame, lookup: DataFrame, key: str, hot: DataFrame, salts: int = 32, spread: str | None = None) -> DataFrame:
    """Inner equi-join on `key` where `lookup` has one row a key: rows of a hot key are spread over `salts` tasks, and only
    its lookup row is repeated. `hot` must be bounded: keys of over a stated share of all rows. `spread` names a column to salt by, for a repeatable salt."""
    marks = F.broadcast(hot.select(F.col(key).alias("__hot")))
    by = F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)) if spread else F.pmod(F.monotonically_increasing_id(), F.lit(salts))
    left = facts.join(marks, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.when(F.col("__hot").isNotNull(), by).otherwise(F.lit(0)).cast("int")).drop("__hot")
    right = (
        lookup.join(marks, F.col(key) == F.col("__hot"), "left")
        .withColumn("__salt", F.explode(F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        .drop("__hot")
    )
    return left.join(right, [key, "__salt"]).drop("__salt")


@contextmanager
def cancellable(spark: SparkSession, what: str) -> Iterator[Callable[[], None]]:
    """Gives a function that cancels the jobs started inside, from any thread; they end with an error there."""
    context, tag = spark.sparkContext, f"{what}-{uuid.uuid4().hex}"
    context.addJobTag(tag)
    try:
        yield lambda: context.cancelJobsWithTag(tag)
    finally:
        context.removeJobTag(tag)
