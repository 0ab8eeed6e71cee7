"""Structured Streaming: token buckets, session expiry and event-time windows.

Events have ts (a timestamp, with or without time zone), user_id, event_type and value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watermarked(events: DataFrame, late: str) -> DataFrame:
    """Watermarks stand on timestamps with a time zone only."""
    return events.withColumn("ts", F.col("ts").cast("timestamp_ltz")).withWatermark("ts", late)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and value by type and window; on a stream, rows later than ``late`` are dropped."""
    counted = watermarked(events, late).groupBy(F.window("ts", size), "event_type")
    return counted.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A user's events without a pause of ``gap``; a session ends ``gap`` after its last event."""
    grouped = watermarked(events, late).groupBy(F.session_window("ts", gap), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def token_bucket(events: DataFrame, per_minute: float = 60.0, burst: float = 10.0, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """Whether each event (user_id, ts) finds a token; a new key starts with a full bucket.

    A bucket holds ``burst`` tokens at most and refills continuously.  Streams only; the events
    of a batch are taken by time, those later than ``late`` get no answer.  The state of a key
    is dropped once the watermark is ``idle_ms`` past its last event, so an idle key costs
    nothing; by then its bucket must be full again.  The timeout goes by event time, as one by
    processing time would keep an ``availableNow`` query running for ever.
    """
    rate = per_minute / 60.0
    if idle_ms * rate < burst * 1000:
        raise ValueError("idle_ms is too short for a bucket to fill")

    def spend(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (burst, None)
        allowed, wait = [], []
        part = pd.concat(list(parts)).sort_values("micros", kind="stable")
        for now in part["micros"] / 1e6:
            if last is not None:
                tokens = min(burst, tokens + max(0.0, now - last) * rate)
            last = now if last is None else max(last, now)
            allowed.append(tokens >= 1)
            wait.append(0.0 if tokens >= 1 else (1 - tokens) / rate)
            tokens -= tokens >= 1
        state.update((float(tokens), float(last)))
        state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"user_id": key[0], "micros": part["micros"], "allowed": allowed, "retry_after": wait})

    keyed = watermarked(events.filter("ts is not null").select("user_id", "ts"), late).withColumn("micros", F.unix_micros("ts"))
    out = keyed.groupBy("user_id").applyInPandasWithState(spend, "user_id long, micros long, allowed boolean, retry_after double", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("user_id", F.timestamp_micros("micros").alias("ts"), "allowed", "retry_after")
