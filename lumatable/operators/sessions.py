"""Sessions of events per key, separated by gaps of inactivity, from merging interval state.

Every event opens an interval of the gap's length, and overlapping intervals of a key merge. Merging does not depend on order, so one
operator serves batch and stream: a batch of events becomes intervals, first within slots of time, so that a key with a third
of all events is spread over many tasks, then over the slots' merged intervals, of which a key has at most slot / gap in
each slot whatever the number of events. SessionState keeps the intervals between batches: those that the watermark has
passed are closed, the others stay open and take in what comes; an event later than the watermark re-opens what it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumatable.functions.instants import number_us
from lumatable.functions.text import camera_key
from lumatable.runtime import drop_path, materialize, path_exists, release, scratch_path, table

#: Seconds of inactivity that still belong to a session, and the width of the slots of the first step.
GAP_S = 1_800
SLOT_S = 86_400


def merge_intervals(df: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Merge rows (keys, begin, end, n) of each key whose distance is at most `gap`; n adds up. Rows may overlap."""
    order = Window.partitionBy(*keys).orderBy("begin", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__open", F.when(before.isNull() | (F.col("begin") - before > gap), 1).otherwise(0))
    numbered = marked.withColumn("__run", F.sum("__open").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "__run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("__run")


def opened(events: DataFrame, key: str, second: str, event_id: str, gap: int, slot: int) -> DataFrame:
    """Intervals (key, begin, end, n) of a batch of events, merged within slots of time."""
    slim = events.select(F.col(key).alias("key"), F.col(second).cast("bigint").alias("t"), F.col(event_id).alias("id")).where(F.col("key").isNotNull() & F.col("t").isNotNull())
    moments = slim.distinct().withColumn("slot", F.floor(F.col("t") / slot)).groupBy("key", "slot", "t").agg(F.count(F.lit(1)).alias("n"))
    return merge_intervals(moments.select("key", "slot", F.col("t").alias("begin"), F.col("t").alias("end"), "n"), ["key", "slot"], gap).select("key", "begin", "end", "n")


def sessions(events: DataFrame, key: str, second: str, event_id: str, gap: int = GAP_S, slot: int = SLOT_S) -> DataFrame:
    """Sessions (key, begin, end, n): longest runs of a key's events in which no two neighbours are more than `gap` apart.

    n counts distinct event ids. Events without a key or time belong to none; without an id they count as one event. Repeated
    rows count once. An empty table gives no rows.
    """
    return merge_intervals(opened(events, key, second, event_id, gap, slot), ["key"], gap)


class SessionState:
    """Interval state in a folder of the shared file system, taken from batch to batch.

    `late` is how far, in seconds, the watermark stays behind the latest event. A session is closed once no event that is on time
    can reach it any more. An event behind the watermark is kept beside the closed sessions and merged with those it touches, so
    no event is lost, however late. Rows repeated within a batch count once; sources must not give a row in two batches.
    A batch that runs again after a failure replaces what it wrote before.
    """

    OPEN = "key string, begin bigint, end bigint, n bigint"

    def __init__(self, spark: SparkSession, folder: str, gap: int = GAP_S, late: int = 86_400, slot: int = SLOT_S):
        self.spark, self.folder, self.gap, self.late, self.slot = spark, folder.rstrip("/"), gap, late, slot

    def _read(self, kind: str, number: int | None = None) -> DataFrame:
        """Intervals of one batch, or of all up to now; a first batch finds none."""
        path = f"{self.folder}/{kind}" if number is None else f"{self.folder}/{kind}/batch={number}"
        return self.spark.read.schema(self.OPEN).option("recursiveFileLookup", "true").parquet(path) if path_exists(self.spark, path) else self.spark.createDataFrame([], self.OPEN)

    def absorb(self, events: DataFrame, number: int, key: str, second: str, event_id: str) -> None:
        """Take in batch `number` of events; batches are numbered from 0."""
        fresh = materialize(opened(events, key, second, event_id, self.gap, self.slot).withColumn("key", F.col("key").cast("string")), "opened")
        mark, top = self._watermark(number - 1), fresh.agg(F.max("end")).first()[0]
        after = mark if top is None else max(mark, top - self.late)
        behind = fresh.where(F.col("begin") < mark)
        merged = materialize(merge_intervals(self._read("open", number - 1).unionByName(fresh.where(F.col("begin") >= mark)), ["key"], self.gap), "merged")
        over = F.col("end") + self.gap < after
        merged.where(over).unionByName(behind).write.mode("overwrite").parquet(f"{self.folder}/closed/batch={number}")
        merged.where(~over).write.mode("overwrite").parquet(f"{self.folder}/open/batch={number}")
        self.spark.createDataFrame([(after,)], "mark bigint").write.mode("overwrite").parquet(f"{self.folder}/mark/batch={number}")
        release(fresh, merged)
        if number > 1:  # the batch before may run again, with the state before it
            for kind in ("open", "mark"):
                drop_path(self.spark, f"{self.folder}/{kind}/batch={number - 2}")

    def _watermark(self, number: int) -> int:
        path = f"{self.folder}/mark/batch={number}"
        return self.spark.read.schema("mark bigint").parquet(path).first()[0] if path_exists(self.spark, path) else -(1 << 62)

    def sessions(self, number: int) -> DataFrame:
        """All sessions (key, begin, end, n) after batch `number`, closed and open, late events merged in."""
        return merge_intervals(self._read("closed").unionByName(self._read("open", number)), ["key"], self.gap)

    def start(self, events: DataFrame, checkpoint: str, key: str, second: str, event_id: str, interval: str | None = None) -> StreamingQuery:
        """The same as a stream: each micro-batch is absorbed, at an interval, or all that is there where none is given."""
        writer = events.writeStream.foreachBatch(lambda batch, number: self.absorb(batch, number, key, second, event_id)).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query p3_found: shooting sessions of each camera along images.created_at."""
    images = table(spark, sf_dir, "images").select("id", camera_key(F.col("camera_model")).alias("camera"), F.floor(number_us("created_at") / 1_000_000).alias("t"))
    return sessions(images, "camera", "t", "id").select(F.col("key").alias("camera_model"), F.col("begin").alias("session_start"), F.col("end").alias("session_end"), F.col("n").alias("n_images"))


#: Batches in which p3_replayed takes the images, and by how many seconds its watermark stays behind.
REPLAY_BATCHES, REPLAY_LATE_S = 6, 7 * 86_400


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query p3_replayed: the sessions of p3_found from images that arrive in order of imported_at, in batches, many later than the watermark.

    Copies of a row arrive together, as they have the same imported_at; images without one arrive first.
    """
    images = table(spark, sf_dir, "images").select("id", "imported_at", camera_key(F.col("camera_model")).alias("camera"), F.floor(number_us("created_at") / 1_000_000).alias("t"))
    slim = materialize(images.where("camera is not null and t is not null"), "arrivals")
    cuts = slim.approxQuantile("imported_at", [i / REPLAY_BATCHES for i in range(1, REPLAY_BATCHES)], 0.01)  # where they are cut changes no result
    state = SessionState(spark, scratch_path(spark, "sessions"), late=REPLAY_LATE_S)
    at = F.coalesce(F.col("imported_at").cast("double"), F.lit(float("-inf")))
    for i in range(len(cuts) + 1):
        part = slim.where((at > cuts[i - 1] if i else F.lit(True)) & (at <= cuts[i] if i < len(cuts) else F.lit(True)))
        state.absorb(part, i, "camera", "t", "id")
    release(slim)
    return state.sessions(len(cuts)).select(F.col("key").alias("camera_model"), F.col("begin").alias("session_start"), F.col("end").alias("session_end"), F.col("n").alias("n_images"))
