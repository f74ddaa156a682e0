"""Bursts: runs of files shot in quick succession, folded in global time order without one task sorting all files.

A file joins the burst before it if it shares a shot with any member, or if it follows the last member within two seconds
from the same camera; another camera's file in between breaks a burst. Rows where the fold must close (the neighbour rule fails, and no shot
seen before comes again) are found with running maxima: within slots of time, and over the slots' own maxima. Between such
rows the fold runs sequentially, as a stream over sorted partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumatable.runtime import materialize, release, ship

GAP_S, SLOT_S = 2, 3_600


def running_max(df: DataFrame, values: dict[str, Column], slot: str, order: list) -> DataFrame:
    """Adds for each name the largest value in all rows before, in the order of (slot, order), by partial maxima of slots."""
    w = Window.partitionBy(slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    staged = df.withColumns({f"__v_{k}": v for k, v in values.items()})
    tops = staged.groupBy(slot).agg(*(F.max(f"__v_{k}").alias(f"__top_{k}") for k in values))
    over_slots = Window.orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)  # one row for each slot of time
    before = tops.select(slot, *(F.max(f"__top_{k}").over(over_slots).alias(f"__before_{k}") for k in values))
    within = staged.withColumns({f"__within_{k}": F.max(f"__v_{k}").over(w) for k in values}).join(before, slot)
    return within.withColumns({k: F.greatest(f"__within_{k}", f"__before_{k}") for k in values}).drop(*(f"__{p}_{k}" for p in ("v", "within", "before") for k in values))


def segments(files: DataFrame) -> DataFrame:
    """Files (id, created_at, camera, shot_key) with `segment`, the place (created_at, id) of the first file of a stretch that no burst crosses."""
    place = F.struct("created_at", "id")
    dated = materialize(files.where("created_at is not null").select("id", "created_at", "camera", "shot_key"), "burst-files")
    last = dated.groupBy("shot_key").agg(F.max(place).alias("shot_last"))
    rows = materialize(dated.join(last, "shot_key").withColumn("slot", F.floor(F.col("created_at") / SLOT_S)), "burst-rows")
    order = ["created_at", "id"]
    whole = F.struct(F.col("created_at").alias("created_at"), F.col("id").alias("id"), F.struct(F.col("camera").alias("camera")).alias("of"))
    seen = running_max(rows, {"prev": whole, "open_until": F.col("shot_last")}, "slot", order)
    near = (F.col("created_at") - F.col("prev.created_at") <= GAP_S) & F.col("camera").eqNullSafe(F.col("prev.of.camera"))
    cut = F.col("prev").isNull() | (~near & (F.col("open_until") < place))
    marked = materialize(seen.select("id", "created_at", "camera", "shot_key", "slot", cut.alias("cut")), "burst-cuts")
    release(dated, rows)
    found = running_max(marked, {"earlier_cut": F.when(F.col("cut"), place)}, "slot", order)
    return found.withColumn("segment", F.when(F.col("cut"), place).otherwise(F.col("earlier_cut"))).select("id", "created_at", "camera", "shot_key", "segment")


def fold(rows: Iterator[tuple]) -> Iterator[tuple[int, int]]:
    """(id, burst id) of rows (id, second, camera, shot, segment) in order; a burst's id is that of its first file. Bursts of less than two shots are left out."""
    members: list[int] = []
    shots: set = set()
    last = None
    for i, t, camera, shot, segment in rows:
        joins = members and segment == last[2] and (shot in shots or (0 <= t - last[0] <= GAP_S and camera == last[1]))
        if not joins:
            if len(shots) > 1:
                yield from ((m, members[0]) for m in members)
            members, shots = [], set()
        members.append(i)
        shots.add(shot)
        last = (t, camera, segment)
    if len(shots) > 1:
        yield from ((m, members[0]) for m in members)


def find_bursts(files: DataFrame) -> DataFrame:
    """(id, burst_id) of files (id, created_at, camera, shot_key) in bursts of at least two shots. Undated files are in none; files
    without a camera count as one camera."""
    cut = materialize(segments(files), "burst-segments")
    several = cut.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("segment")
    key = F.struct("segment.created_at", "segment.id")
    sorted_rows = cut.join(several, "segment", "left_semi").select("id", "created_at", "camera", "shot_key", key.alias("segment")).repartition("segment").sortWithinPartitions("segment", "created_at", "id")
    flat = sorted_rows.select("id", "created_at", F.coalesce("camera", F.lit("")).alias("camera"), "shot_key", F.col("segment.id").alias("segment_id"))

    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in b.itertuples(index=False, name=None))
        held: list[tuple[int, int]] = []
        for pair in fold(rows):
            held.append(pair)
            if len(held) >= 50_000:
                yield pd.DataFrame(held, columns=["id", "burst_id"])
                held = []
        yield pd.DataFrame(held, columns=["id", "burst_id"])

    return flat.mapInPandas(run, "id bigint, burst_id bigint")
