"""Structured Streaming with state of its own: a keyed state machine, a bounded store of turns, snapshots by batch, progress.

The keyed operators need the RocksDB state store (``STORE``).  Each has a batch twin over a
finished table that gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..sources.files import complete_versions

#: setting and value that the keyed operators need
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: action, the state that it may enter from, and the state that it leads to
Transitions = list[tuple[str, str, str]]
MOVED = "key long, micros long, action string, allowed boolean, state string"


class Machine(StatefulProcessor):
    """Keeps a key's state and the time of its last event; a timer drops both once the watermark is ``idle`` past it."""

    def __init__(self, transitions: Transitions, initial: str, idle_ms: int) -> None:
        self.leads, self.initial, self.idle_ms = {(action, state): to for action, state, to in transitions}, initial, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state string, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, last = self.held.get() if self.held.exists() else (self.initial, None)
        part, out = pd.concat(list(rows)).sort_values(["micros", "action"], kind="stable"), []
        for micros, action in zip(part["micros"].tolist(), part["action"].tolist(), strict=True):
            if last is not None and micros - last >= self.idle_ms * 1000:
                state = self.initial
            to = self.leads.get((action, state))
            state, last = to or state, micros if last is None else max(last, micros)
            out.append((key[0], micros, action, to is not None, state))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(last // 1000 + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        self.held.update((state, last))
        yield pd.DataFrame(out, columns=["key", "micros", "action", "allowed", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame({"key": [], "micros": [], "action": [], "allowed": [], "state": []}).astype({"key": "int64", "micros": "int64", "action": object, "allowed": bool, "state": object})

    def close(self) -> None:
        pass


def moves(events: DataFrame) -> DataFrame:
    return events.filter("key is not null and ts is not null").select("key", F.col("ts").cast("timestamp_ltz").alias("ts"), "action").withColumn("micros", F.unix_micros("ts"))


def shown(moved: DataFrame) -> DataFrame:
    return moved.select("key", F.timestamp_micros("micros").alias("ts"), "action", "allowed", "state")


def machine(events: DataFrame, transitions: Transitions, initial: str, idle_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """(key, ts, action, allowed, state): whether each event (key, ts, action) may happen in its key's state, and the state after it.

    An action that is not allowed changes nothing.  A key without an event for ``idle_ms`` starts
    anew.  Events of a batch are taken by time, then by action; those later than ``late`` may come out of order.  Streams only;
    ``machine_batch`` is for tables.
    """
    keyed = moves(events).withWatermark("ts", late).groupBy("key")
    return shown(keyed.transformWithStateInPandas(Machine(transitions, initial, idle_ms), MOVED, "append", "EventTime"))


def machine_batch(events: DataFrame, transitions: Transitions, initial: str, idle_ms: int = 3_600_000) -> DataFrame:
    """What ``machine`` gives for a finished table.

    Between two pauses, the state is a fold over the key's actions.  Pauses cut a key's
    history into runs, and a run's actions meet in one array.
    """
    order = Window.partitionBy("key").orderBy("micros", "action")
    paused = (F.col("micros") - F.lag("micros").over(order) >= idle_ms * 1000).cast("int")
    runs = moves(events).withColumn("new", F.coalesce(paused, F.lit(0))).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    leads = F.create_map(*[F.lit(x) for action, state, to in transitions for x in (f"{action}\n{state}", to)])
    grouped = runs.groupBy("key", "run").agg(F.sort_array(F.collect_list(F.struct("micros", "action"))).alias("moves"))
    step = lambda acc, m: F.struct(F.coalesce(leads[F.concat(m["action"], F.lit("\n"), acc["state"])], acc["state"]).alias("state"), F.array_append(acc["out"], F.struct(leads[F.concat(m["action"], F.lit("\n"), acc["state"])].isNotNull().alias("allowed"), F.coalesce(leads[F.concat(m["action"], F.lit("\n"), acc["state"])], acc["state"]).alias("state"))).alias("out"))
    start = F.struct(F.lit(initial).alias("state"), F.array().cast("array<struct<allowed: boolean, state: string>>").alias("out"))
    folded = grouped.select("key", F.arrays_zip("moves", F.aggregate("moves", start, step)["out"].alias("out")).alias("z"))
    each = folded.select("key", F.explode("z").alias("x")).select("key", "x.moves.micros", "x.moves.action", "x.out.allowed", "x.out.state")
    return shown(each)


class LastTurns(StatefulProcessor):
    """The newest turns of a conversation; a timer drops them once the watermark is ``idle`` past the last one, if that is given."""

    def __init__(self, most: int, idle_ms: int | None) -> None:
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("turns", "turn long, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values("turn", kind="stable")
        kept, out = [(t, x) for t, x in self.held.get()] if self.held.exists() else [], []
        for turn, text in zip(part["turn"].tolist(), part["text"].tolist(), strict=True):
            kept = [*kept, (turn, text)][-self.most :]
            out.append((key[0], turn, len(kept), kept[0][0], sum(len(x or "") for _, x in kept)))
        self.held.put(kept)
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            last = int(part["micros"].max()) // 1000
            self.handle.registerTimer(max(last + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=HELD)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame({c: [] for c in HELD}).astype("int64")

    def close(self) -> None:
        pass


HELD = ["conv_id", "turn", "kept", "oldest", "letters"]


def last_turns(turns: DataFrame, most: int = 40, idle_ms: int | None = None, late: str = "10 minutes") -> DataFrame:
    """(conv_id, turn, kept, oldest, letters) after each turn (conv_id, turn, text): how many of the newest ``most`` turns are held, the oldest of them, and their letters.

    Turns of a batch are taken in order.  With ``idle_ms``, turns have a time ts, and a conversation is forgotten once the
    watermark is that far past its last one; a time to live by processing time would keep an ``availableNow`` query
    running for ever.  Streams only; ``last_turns_batch`` is for tables.
    """
    known = turns.filter("conv_id is not null and turn is not null")
    if idle_ms is not None:
        ts = F.col("ts").cast("timestamp_ltz")
        known = known.select("conv_id", "turn", "text", ts.alias("ts")).withWatermark("ts", late).withColumn("micros", F.unix_micros("ts"))
    else:
        known = known.select("conv_id", "turn", "text")
    return known.groupBy("conv_id").transformWithStateInPandas(LastTurns(most, idle_ms), ", ".join(f"{c} long" for c in HELD), "append", "None" if idle_ms is None else "EventTime")


def last_turns_batch(turns: DataFrame, most: int = 40) -> DataFrame:
    """What ``last_turns`` gives for a finished table: one window over the newest ``most`` turns."""
    newest = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1 - most, 0)
    known = turns.filter("conv_id is not null and turn is not null")
    return known.select("conv_id", "turn", F.count("*").over(newest).alias("kept"), F.first("turn").over(newest).alias("oldest"), F.sum(F.length(F.coalesce("text", F.lit("")))).over(newest).alias("letters"))


def snapshots(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch becomes the version of its number below ``path``, which ``sources.files.snapshot`` reads.

    A batch that comes again, as one may after a failure, finds its complete version and writes nothing; what a
    failure left half written is replaced.  Readers see complete versions only.
    """

    def write(batch: DataFrame, number: int) -> None:
        if number not in complete_versions(batch.sparkSession, path):
            batch.write.mode("overwrite").json(f"{path}/version={number}")

    return write


def counted(rows: DataFrame, failed: Column, name: str = "progress") -> DataFrame:
    """``rows``, with the number of rows and of ``failed`` ones observed as each batch passes by."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(failed, F.lit(False))).alias("failed"))


class Progress(StreamingQueryListener):
    """Sums what ``counted`` observes, by query name: rows, failed, batches, and whether the query has ended."""

    def __init__(self, name: str = "progress") -> None:
        self.name, self.sums, self.names = name, {}, {}

    def of(self, query: str) -> dict:
        return self.sums.setdefault(query, {"rows": 0, "failed": 0, "batches": 0, "ended": False})

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name
        self.of(event.name)

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None and event.progress.numInputRows:
            sums = self.of(event.progress.name)
            sums["rows"] += seen["rows"]
            sums["failed"] += seen["failed"]
            sums["batches"] += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.of(self.names.get(str(event.id)))["ended"] = True


def with_store(spark: SparkSession) -> SparkSession:
    """The session, set to the state store that the keyed operators need."""
    spark.conf.set(*STORE)
    return spark
