"""Health report, session statistics and evaluation statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import wilson


def zero_filled(spark, rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of ``column`` for all ``values``, 0 where there are none."""
    names = spark.createDataFrame([(v,) for v in values], f"{column} string")
    return names.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def rates(events: DataFrame) -> DataFrame:
    """Retention and discard rates, null without events."""
    part = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    return events.agg(
        F.count("*").alias("n_events"), F.count_distinct("session_id").alias("n_sessions"), F.round(F.try_divide(part("retained", "latent"), F.count("*")), 6).alias("retention_rate"),
        F.round(F.try_divide(part("discarded"), F.count("*")), 6).alias("discard_rate"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
    )


def session_stats(events: DataFrame) -> DataFrame:
    """Per session: events, distinct tools and scopes, first and last time, and the most frequent tool (ties by name)."""
    tools = events.groupBy("session_id", "tool").agg(F.count("*").alias("n"))
    top = tools.groupBy("session_id").agg(F.min_by("tool", F.struct((-F.col("n")).alias("n"), "tool")).alias("top_tool"))
    return events.groupBy("session_id").agg(
        F.count("*").alias("n_events"), F.count_distinct("tool").alias("n_tools"), F.count_distinct("scope_ref").alias("n_scopes"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")
    ).join(top, "session_id")


def last_evidence(events: DataFrame, k: int = 5) -> DataFrame:
    """The last ``k`` events of each session, by time."""
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("session_id", "id", "rank")


def turn_pairs(turns: DataFrame) -> DataFrame:
    """Assistant turns with the nearest earlier user turn of the conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w)
    return turns.withColumn("user_turn", asked).where("role = 'assistant'").select("conv_id", "turn", "user_turn")


def assistant_runs(turns: DataFrame) -> DataFrame:
    """Runs of consecutive assistant turns: start, length."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    new = F.when(F.lag("turn").over(w) + 1 == F.col("turn"), 0).otherwise(1)
    runs = turns.where("role = 'assistant'").withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    return runs.groupBy("conv_id", "run").agg(F.min("turn").alias("start_turn"), F.count("*").alias("n_turns")).drop("run")


def buffer_batches(turns: DataFrame, size: int = 5) -> DataFrame:
    """Batches of ``size`` turns of a conversation: first and last turn and characters."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    batch = F.floor((F.row_number().over(w) - 1) / size).cast("int")
    return turns.withColumn("batch", batch).groupBy("conv_id", "batch").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("n_chars"))


def hit_interval(rows: DataFrame, group: str, hit) -> DataFrame:
    """Hits, trials and the 95 % Wilson interval of each group."""
    g = rows.groupBy(group).agg(F.sum(hit.cast("int")).alias("hits"), F.count("*").alias("n"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return g.select(group, "hits", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))
