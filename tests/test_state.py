"""Streams with state, read to their end, against their batch twins; snapshots by batch; progress."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cobaltine.sources import files
from cobaltine.streaming import state

START = datetime(2025, 1, 1)
STEPS = [("open", "new", "asked"), ("plan", "asked", "planned"), ("plan", "done", "planned"), ("confirm", "planned", "done")]


@pytest.fixture
def store(spark):
    before = spark.conf.get(state.STORE[0], None)
    state.with_store(spark)
    yield spark
    spark.conf.unset(state.STORE[0]) if before is None else spark.conf.set(state.STORE[0], before)


def stream_of(spark, parts, schema, folder):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(spark, df, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(240)
    finally:
        query.stop()
    return spark.table(name)


def test_state_machine(store, tmp_path):
    rng, rows, at = random.Random(1), [], START
    for _ in range(240):
        at += timedelta(seconds=rng.choice([1, 5, 60, 900, 5000]))
        rows.append((rng.randint(1, 3), at, rng.choice(["open", "plan", "confirm"])))
    schema = "key long, ts timestamp_ntz, action string"
    stream = stream_of(store, [rows[:80], rows[80:150], rows[150:]], schema, str(tmp_path / "in"))
    got = sorted(map(tuple, drained(store, state.machine(stream, STEPS, "new", idle_ms=3_600_000), "machine", tmp_path).collect()))
    batch = state.machine_batch(store.createDataFrame(rows, schema), STEPS, "new", idle_ms=3_600_000)
    want, held = [], {}
    for key, ts, action in sorted(rows, key=lambda r: (r[1], r[2])):
        now, last = held.get(key, ("new", ts))
        now = "new" if ts - last >= timedelta(hours=1) else now
        to = {(a, s): t for a, s, t in STEPS}.get((action, now))
        held[key] = to or now, ts
        want.append((key, ts, action, to is not None, to or now))
    assert got == sorted(want) and sorted(map(tuple, batch.collect())) == sorted(want)
    assert {r[3] for r in want} == {True, False} and len({r[4] for r in want}) == 4


def test_last_turns(store, tmp_path):
    rows = [(c, t, "x" * (t % 5) if t % 7 else None) for c in (1, 2) for t in range(60 * c)]
    rows.sort(key=lambda r: r[1])
    schema = "conv_id long, turn long, text string"
    stream = stream_of(store, [rows[:50], rows[50:51], rows[51:]], schema, str(tmp_path / "in"))
    got = sorted(map(tuple, drained(store, state.last_turns(stream), "turns", tmp_path).collect()))
    want = sorted(map(tuple, state.last_turns_batch(store.createDataFrame(rows, schema)).collect()))
    assert got == want and max(r[2] for r in want) == 40 and want[-1][:4] == (2, 119, 40, 80)


def test_idle_conversations_are_forgotten(store, tmp_path):
    at = lambda hours: START + timedelta(hours=hours)
    parts = [[(1, 0, "a", at(0)), (2, 0, "b", at(0))], [(1, 1, "c", at(1))], [(3, 0, "d", at(30))], [(3, 1, "e", at(31))], [(1, 2, "f", at(32)), (2, 1, "g", at(32))]]
    stream = stream_of(store, parts, "conv_id long, turn long, text string, ts timestamp_ntz", str(tmp_path / "in"))
    got = {(r["conv_id"], r["turn"]): r["kept"] for r in drained(store, state.last_turns(stream, idle_ms=7_200_000), "idle", tmp_path).collect()}
    assert got == {(1, 0): 1, (2, 0): 1, (1, 1): 2, (3, 0): 1, (3, 1): 2, (1, 2): 1, (2, 1): 1}


def test_snapshots_by_batch_and_progress(spark, tmp_path):
    schema, path, listener = "id long, bad boolean", str(tmp_path / "out"), state.Progress()
    stream = stream_of(spark, [[(1, True), (2, False)], [(3, None)], [(4, True)]], schema, str(tmp_path / "in"))
    spark.streams.addListener(listener)
    try:
        query = state.counted(stream, F.col("bad")).writeStream.queryName("snaps").foreachBatch(state.snapshots(path)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        for _ in range(100):
            if listener.sums.get("snaps", {}).get("ended"):
                break
            spark._jvm.Thread.sleep(100)
    finally:
        spark.streams.removeListener(listener)
    assert listener.sums["snaps"] == {"rows": 4, "failed": 2, "batches": 3, "ended": True}
    assert files.complete_versions(spark, path) == [0, 1, 2]
    write, again = state.snapshots(path), spark.createDataFrame([(9, True)], schema)
    write(again, 1)  # a batch that comes again changes nothing
    assert [r["id"] for r in files.snapshot(spark, path, "id long", version=1).collect()] == [3]
    (tmp_path / "out" / "version=2" / "_SUCCESS").unlink()  # as if its write had failed
    assert [r["id"] for r in files.snapshot(spark, path, "id long").collect()] == [3]
    write(again, 2)
    assert [r["id"] for r in files.snapshot(spark, path, "id long").collect()] == [9]
    assert not files.snapshot(spark, str(tmp_path / "nothing"), "id long").collect()
