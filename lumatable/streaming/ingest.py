"""Import as a stream: arriving rows are checked against what was accepted and committed in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lumatable.runtime import drop_path, materialize, path_exists, release

#: Column and number of the folders by key into which each batch of the target is cut.
SHARD, SHARDS = "key_shard", 64


def commit_batch(spark: SparkSession, target: str, key: str):
    """A function for foreachBatch that appends rows whose key is new, in this batch and in the target. Rows without a key have nothing
    to be compared by and are all appended, as the batch import keeps them.

    The target is kept in folders by the first two digits of the key's hash, so a batch reads only those its own keys fall into.
    Each micro-batch writes a folder of its own number, so a batch that is run again after a failure replaces what it wrote before.
    """

    def run(batch: DataFrame, number: int) -> None:
        folder = f"{target}/batch={number}"
        drop_path(spark, folder)
        keyed = materialize(batch.withColumn(SHARD, F.pmod(F.xxhash64(key), F.lit(SHARDS)).cast("int")), "arrived")
        first = keyed.where(F.col(key).isNotNull()).groupBy(SHARD, key).agg(F.min_by(F.struct(*batch.columns), F.struct(*[c for c in batch.columns if c != key])).alias("r")).select(SHARD, "r.*")
        if _exists(spark, target):
            met = [r[0] for r in keyed.select(SHARD).distinct().collect()]  # at most SHARDS numbers
            known = _target(spark, target, batch.schema)
            first = first.join(known.where(F.col(SHARD).isin(met)).select(SHARD, key).distinct(), [SHARD, key], "left_anti")
        fresh = first.unionByName(keyed.where(F.col(key).isNull()))
        fresh.select(*batch.columns, SHARD).write.mode("overwrite").partitionBy(SHARD).parquet(folder)
        release(keyed)

    return run


def _target(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType()), StructField(SHARD, IntegerType())])).option("basePath", target).parquet(target)


def _exists(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, path) and bool(spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(path)))


def start(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "hash", interval: str | None = None, fmt: str = "parquet") -> StreamingQuery:
    """A query that imports files of rows as they arrive below `source`: at an interval, or all that is there where none is given."""
    rows = spark.readStream.format(fmt).schema(schema).option("recursiveFileLookup", "true").load(source)
    writer = rows.writeStream.foreachBatch(commit_batch(spark, target, key)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def accepted(spark: SparkSession, target: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(target)


def sliding_counts(events: DataFrame, at: str, width: str, step: str, late: str = "1 hour") -> DataFrame:
    """Counts by overlapping windows of time, of a table or, behind a watermark, of a stream."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    return marked.where(F.col(at).isNotNull()).groupBy(F.window(at, width, step)).agg(F.count(F.lit(1)).alias("n"))


def daily_counts(events: DataFrame, at: str, late: str = "1 hour") -> DataFrame:
    """Counts by tumbling day of a stream, final once the watermark has passed the day."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 day")).agg(F.count(F.lit(1)).alias("n"))


def distinct_within(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """A stream without repeats of a key within the watermark; the state is dropped behind it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
