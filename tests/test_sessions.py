import random

from conftest import rows
from pyspark.sql import functions as F

from lumatable.operators.sessions import SessionState, merge_intervals, sessions


def brute(events, gap):
    out, by = set(), {}
    for k, t, i in set(events):
        if k is not None and t is not None:
            by.setdefault(k, []).append((t, i))
    for k, seen in by.items():
        run = []
        for t, i in sorted(seen, key=lambda x: (x[0], str(x[1]))):
            if run and t - run[-1][0] > gap:
                out.add((k, run[0][0], run[-1][0], len(run)))
                run = []
            run.append((t, i))
        out.add((k, run[0][0], run[-1][0], len(run)))
    return sorted(out, key=repr)


def test_random_events_with_a_hot_key(spark):
    rng = random.Random(3)
    events = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *range(0, 400_000, 977)]), i) for i in range(3_000)]
    events += events[:200]
    df = spark.createDataFrame(events, "key string, t bigint, id bigint").withColumn("slot", F.lit("x")).withColumn("n", F.lit(0))
    assert rows(sessions(df, "key", "t", "id", gap=1_800, slot=20_000)) == brute(events, 1_800)


def test_gap_of_exactly_the_limit_joins_over_slots(spark):
    df = spark.createDataFrame([("c", 86_399, 1), ("c", 88_199, 2), ("c", 90_000, 3)], "key string, t bigint, id bigint")
    assert rows(sessions(df, "key", "t", "id")) == [("c", 86_399, 88_199, 2), ("c", 90_000, 90_000, 1)]


def test_empty(spark):
    assert sessions(spark.createDataFrame([], "key string, t bigint, id bigint"), "key", "t", "id").count() == 0


def test_merge_of_nested_intervals(spark):
    df = spark.createDataFrame([("k", 0, 100, 1), ("k", 10, 20, 1), ("k", 105, 110, 1), ("k", 200, 201, 1)], "key string, begin bigint, end bigint, n bigint")
    assert rows(merge_intervals(df, ["key"], 10)) == [("k", 0, 110, 3), ("k", 200, 201, 1)]


def arriving(rng):
    """Events in batches, some far behind those that came before."""
    events = [(rng.choice(["a", "a", "b"]), rng.randrange(0, 400_000, 61), i) for i in range(1_200)]
    on_time, late = sorted(events[:1_000], key=lambda e: e[1]), events[1_000:]
    batches = [on_time[i : i + 250] for i in range(0, 1_000, 250)]
    return [batches[0], batches[1] + late[:80], batches[2] + batches[2][:20], batches[3] + late[80:], [], late[:0] + [("c", 5, 9_000), ("a", None, 9_001), (None, 7, 9_002)]]


def test_state_takes_in_late_events(spark, tmp_path):
    """Whatever the batches and however late events come, the sessions are those of all events at once; old sessions are closed."""
    batches = arriving(random.Random(8))
    schema = "key string, t bigint, id bigint"
    state = SessionState(spark, str(tmp_path / "s"), gap=1_800, late=10_000, slot=20_000)
    for i, b in enumerate(batches):
        state.absorb(spark.createDataFrame(b, schema), i, "key", "t", "id")
        if i == 2:  # run again, as after a failure
            state.absorb(spark.createDataFrame(b, schema), i, "key", "t", "id")
    assert rows(state.sessions(len(batches) - 1)) == brute([e for b in batches for e in b], 1_800)
    still_open = state._read("open", len(batches) - 1)
    assert state._read("closed").count() > 50 and still_open.count() <= 12 and still_open.agg(F.min("end")).first()[0] >= 400_000 - 12_000 - 1_800


def test_stream_gives_the_same_sessions(spark, tmp_path):
    """A stream of files, one of which holds a late event that joins two closed sessions; a gap of exactly the limit joins."""
    files = [[("a", 0, 1), ("a", 1_800, 2), ("a", 5_000, 3), ("b", 50, 4)], [("zz", 900_000, 5)], [("a", 3_400, 6)]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("cam string, t bigint, id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = SessionState(spark, str(tmp_path / "state"))
    for i, f in enumerate(files):
        spark.createDataFrame(f, "cam string, t bigint, id bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        state.start(stream, str(tmp_path / "c"), "cam", "t", "id").awaitTermination(60)
        if i == 1:
            assert rows(state._read("closed")) == [("a", 0, 1_800, 2), ("a", 5_000, 5_000, 1), ("b", 50, 50, 1)]
    assert rows(state.sessions(2)) == [("a", 0, 5_000, 4), ("b", 50, 50, 1), ("zz", 900_000, 900_000, 1)]
