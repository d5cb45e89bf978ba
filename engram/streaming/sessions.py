"""Session state in a stream: call counters with a regular boost, idle sessions that expire, and the conversation buffer.

State is kept by ``transformWithStateInPandas``, which needs the RocksDB state store (``rocksdb``). Within a micro-batch the events of a
session are taken by (created_at, id); a later batch goes on where the one before ended, also after a restart from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Every tenth call of a session is boosted.
BOOST_EVERY = 10
#: Entries that a buffer is flushed at, and characters of a tool's output that it keeps.
FLUSH_AT, OUTPUT_CHARS = 5, 300
COUNTED = "session_id long, id long, kind string, nth long, tool_nth long, boosted boolean, at timestamp"
BATCHES = "lane int, batch long, session_id long, n_entries int, excerpt string"


def rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Counter(StatefulProcessor):
    """Numbers the events of each session; a session without events for ``idle_ms`` gives a row of kind ``idle`` and is forgotten."""

    def __init__(self, every: int, idle_ms: int):
        self.every, self.idle_ms = every, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counts", "n long, tools long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, tools, last = self.state.get() if self.state.exists() else (0, 0, 0)
        batch = pd.concat(list(rows)).sort_values(["created_at", "id"], kind="stable")
        called = batch["tool"].notna()
        nth = n + pd.Series(range(1, len(batch) + 1), index=batch.index)
        tool_nth = tools + called.cumsum()
        out = pd.DataFrame({"session_id": key[0], "id": batch["id"], "kind": "event", "nth": nth, "tool_nth": tool_nth, "boosted": nth % self.every == 0, "at": batch["created_at"]})
        newest = max(last, int(batch["created_at"].max().timestamp() * 1000))
        self.state.update((n + len(batch), tools + int(called.sum()), newest))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(newest + self.idle_ms)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, tools, last = self.state.get()
        self.state.clear()
        at = pd.Timestamp(last, unit="ms")
        yield pd.DataFrame({"session_id": [key[0]], "id": [None], "kind": ["idle"], "nth": [n], "tool_nth": [tools], "boosted": [False], "at": [at]}).astype({"id": "Int64"})

    def close(self) -> None:
        pass


def counted(events: DataFrame, every: int = BOOST_EVERY, idle: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """``COUNTED`` rows of a stream of events (session_id, id, created_at, tool): each with its number in the session.

    Every ``every``-th is boosted. When the watermark (``late``) passes a session's last event by ``idle``, its counters end with a row of
    kind ``idle`` and start again at one. Events later than the watermark are dropped by Spark. A null session is one of its own.
    """
    rows = events.select("session_id", "id", F.col("created_at").cast("timestamp").alias("created_at"), "tool").withWatermark("created_at", late)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return rows.groupBy("session_id").transformWithStateInPandas(Counter(every, idle_ms), COUNTED, "Append", "EventTime")


class Buffer(StatefulProcessor):
    """Entries in the order of their arrival; each ``size`` of them become a batch that has the session of its last entry."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "n long")
        self.held = handle.getListState("held", "session_id long, line string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self.done.get()[0] if self.done.exists() else 0
        entries = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        batch = pd.concat(list(rows)).sort_values(["created_at", "id"], kind="stable")
        entries += list(zip(batch["session_id"].tolist(), batch["line"].tolist(), strict=True))
        out = []
        while len(entries) >= self.size:
            full, entries = entries[: self.size], entries[self.size :]
            out.append((key[0], done, full[-1][0], len(full), "\n".join(line for _, line in full)))
            done += 1
        self.done.update((done,))
        if entries:
            self.held.put(entries)
        else:
            self.held.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in BATCHES.split(", ")])

    def close(self) -> None:
        pass


def conversation_batches(entries: DataFrame, size: int = FLUSH_AT, lanes: int = 1) -> DataFrame:
    """``BATCHES`` of a stream of entries (session_id, id, created_at, role, tool, title, text): ``size`` entries each, whatever their sessions.

    With one lane this is the buffer of one process, which is one sequence by its nature; more lanes deal the sessions out. Tool outputs are cut.
    """
    cut = F.when(F.length("text") > OUTPUT_CHARS, F.concat(F.substring("text", 1, OUTPUT_CHARS), F.lit("..."))).otherwise(F.coalesce("text", F.lit("")))
    said = F.when(F.col("role") == "tool", F.concat(F.lit("[tool] ["), "tool", F.lit("] "), F.coalesce("title", F.lit("")), F.lit(": "), cut)).otherwise(F.concat(F.lit("[user] "), F.coalesce("text", F.lit(""))))
    lane = F.pmod(F.xxhash64("session_id"), F.lit(lanes)).cast("int").alias("lane")
    return entries.select(lane, "session_id", "id", "created_at", said.alias("line")).groupBy("lane").transformWithStateInPandas(Buffer(size), BATCHES, "Append", "None")
