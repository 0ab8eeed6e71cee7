"""Streams over files, read to their end, against the same rows in plain Python."""

from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from cobaltine.streaming import windows

START = datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def events():
    """Users with bursts and pauses, in order of time; the last two rows only move the watermark on."""
    rows, at = [], START
    for i in range(300):
        at += timedelta(seconds=[0, 1, 2, 30, 400, 4000][(i * i // 7) % 6])
        rows.append((i, at, i % 3, "ab"[i % 2], float(i)))
    return rows


@pytest.fixture(scope="module")
def stream(spark, events, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    end = [(1000 + i, START + timedelta(days=300 + i), 99, "z", 0.0) for i in range(2)]
    for part in (events[:100], events[100:180], events[180:], end[:1], end[1:]):
        spark.createDataFrame(part, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(folder)


def drained(spark, df, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    return spark.table(name).collect()


def test_tumbling(spark, events, stream, tmp_path):
    got = {(r["start"], r["event_type"]): (r["n"], r["total"]) for r in drained(spark, windows.tumbling(stream), "tumbled", tmp_path) if r["event_type"] != "z"}
    n, total = Counter(), Counter()
    for _, ts, _, kind, value in events:
        key = (ts.replace(minute=0, second=0, microsecond=0), kind)
        n[key], total[key] = n[key] + 1, total[key] + value
    assert got == {k: (n[k], total[k]) for k in n}


def test_sessions(spark, events, stream, tmp_path):
    got = sorted((r["user_id"], r["start"], r["end"], r["n"]) for r in drained(spark, windows.sessions(stream), "sat", tmp_path) if r["user_id"] != 99)
    of, gap, wanted = defaultdict(list), timedelta(hours=1), []
    for _, ts, user, _, _ in events:
        of[user].append(ts)
    for user, times in of.items():
        first, last, n = times[0], times[0], 0
        for ts in times:
            if ts >= last + gap:
                wanted.append((user, first, last + gap, n))
                first, n = ts, 0
            last, n = ts, n + 1
        wanted.append((user, first, last + gap, n))
    assert got == sorted(wanted)


def test_token_bucket(spark, events, stream, tmp_path):
    got = sorted((r["user_id"], r["ts"], not r["allowed"], round(r["retry_after"], 6)) for r in drained(spark, windows.token_bucket(stream, per_minute=0.5, burst=3, idle_ms=3_600_000), "spent", tmp_path) if r["user_id"] != 99)
    buckets, wanted, rate = {}, [], 0.5 / 60
    for _, ts, user, _, _ in events:
        tokens, last = buckets.get(user, (3.0, ts))
        tokens = min(3.0, tokens + (ts - last).total_seconds() * rate)
        wanted.append((user, ts, tokens < 1, 0.0 if tokens >= 1 else round((1 - tokens) / rate, 6)))
        buckets[user] = (tokens - (tokens >= 1), ts)
    assert got == sorted(wanted) and 0 < sum(w[2] for w in wanted) < len(wanted)
    with pytest.raises(ValueError, match="idle_ms"):
        windows.token_bucket(stream, per_minute=0.5, burst=3, idle_ms=1000)
