"""Streams of events: count-triggered buffers by conversation, counts by time window, and the evidence pipeline on micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.evidence import actions


def buffered(turns: DataFrame, size: int = 5) -> DataFrame:
    """Batches of ``size`` turns by conversation from a stream (conv_id, turn, text): conv_id, batch, first_turn, last_turn, n_chars.

    The state is the batch number and the turns of the batch that is being filled.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, turns, chars = state.get if state.exists else (0, [], [])
        turns, chars, out = list(turns), list(chars), []
        for part in parts:
            part = part.sort_values("turn")
            turns += part["turn"].tolist()
            chars += part["text"].str.len().fillna(0).astype(int).tolist()
            while len(turns) >= size:
                out.append((key[0], done, turns[0], turns[size - 1], sum(chars[:size])))
                done, turns, chars = done + 1, turns[size:], chars[size:]
        state.update((done, turns, chars))
        yield pd.DataFrame(out, columns=["conv_id", "batch", "first_turn", "last_turn", "n_chars"])

    return turns.groupBy("conv_id").applyInPandasWithState(
        run, "conv_id long, batch int, first_turn long, last_turn long, n_chars long", "done int, turns array<long>, chars array<long>", "append", GroupStateTimeout.NoTimeout
    )


def activity(events: DataFrame, window: str = "1 hour", late: str = "6 hours") -> DataFrame:
    """Events by time window and tool; late events count up to the watermark, then their windows are final."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", window), "tool").agg(F.count("*").alias("n_events"))


def run_evidence(stream: DataFrame, path: str, checkpoint: str):
    """Start the evidence pipeline on each micro-batch; outcomes go to ``path``, one folder for each batch, so a repeated batch overwrites itself."""

    def step(batch: DataFrame, batch_id: int) -> None:
        actions(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
