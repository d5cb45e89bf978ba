"""The evidence pipeline: noise, tags, groups, time islands, tiers and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import confidence_by_tier, importance_by_tags, tier
from ..functions.text import novelty, salience, signal_tags, topic_guess, type_guess


def noise() -> F.Column:
    return (F.trim("title") == "") & (F.trim("excerpt") == "") & (F.trim("args_json") == "")


def context_counts(events: DataFrame, memories: DataFrame, as_of: str, trigger: str = "before_tool") -> DataFrame:
    """(scope_ref, tool, related, conflicts): how many memories an activation for that scope and tool gives, and how many groups of them conflict.

    Each distinct scope and tool of ``events`` is one request.
    """
    from . import selection

    asked = events.select("scope_ref", "tool").distinct().select(F.struct("scope_ref", "tool").alias("request_id"), F.lit(trigger).alias("trigger"), "scope_ref", "tool")
    chosen = selection.select(selection.candidates(memories, asked, as_of)).select("request_id", "id")
    related = chosen.groupBy("request_id").agg(F.count("*").alias("related"))
    same = memories.select("id", "type", "scope_glob", F.array_join("triggers", ",").alias("triggers"))
    groups = chosen.join(same, "id").groupBy("request_id", "type", "scope_glob", "triggers").agg(F.count("*").alias("n")).where("n > 1")
    out = related.join(groups.groupBy("request_id").agg(F.count("*").alias("conflicts")), "request_id", "left")
    return out.select("request_id.*", "related", F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


def enriched(events: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Events with tags, type, topic, salience and novelty. ``context``: ``context_counts``; without it no memory is related."""
    if context is not None:
        events = events.join(context, ["scope_ref", "tool"], "left").withColumn("related", F.coalesce("related", F.lit(0))).withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))
    related, conflicts = (F.lit(0), F.lit(0)) if context is None else (F.col("related"), F.col("conflicts"))
    out = events.withColumn("tags", signal_tags(F.col("excerpt"), F.col("args_json"))).withColumn("type", type_guess(F.col("title"), F.col("excerpt")))
    out = out.withColumn("topic", topic_guess(F.col("type"), F.col("scope_ref"), F.col("tool"), F.col("excerpt")))
    out = out.withColumn("salience", salience(F.col("type"), F.col("title"), F.col("excerpt"), F.col("tool"), related, conflicts))
    return out.withColumn("novelty", novelty(F.col("type"), related, conflicts))


def structural_groups(events: DataFrame) -> DataFrame:
    """One row for each session, scope and tool: first and last time and count."""
    return events.groupBy("session_id", "scope_ref", "tool").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.count("*").alias("n_events"))


def islands(events: DataFrame, gap_minutes: int = 5) -> DataFrame:
    """Structural groups with ``island``: consecutive groups of a session and scope belong together while less than the gap apart.

    A group starts a new island where it begins at or after the latest end so far plus the gap.
    """
    g = structural_groups(events)
    w = Window.partitionBy("session_id", "scope_ref").orderBy("first_at", "last_at", "tool")
    before = F.max("last_at").over(w.rowsBetween(Window.unboundedPreceding, -1))
    g = g.withColumn("_new", F.when(before.isNull() | (F.col("first_at") >= before + F.expr(f"interval {gap_minutes} minutes")), 1).otherwise(0))
    return g.withColumn("island", F.sum("_new").over(w).cast("int")).drop("_new")


def merged_groups(events: DataFrame) -> DataFrame:
    """Islands with their events' count, tags, tier, confidence and importance."""
    return groups_of(placed(events.withColumn("tags", signal_tags(F.col("excerpt"), F.col("args_json")))))


def placed(events: DataFrame) -> DataFrame:
    """``events`` with ``island``."""
    return events.join(islands(events).select("session_id", "scope_ref", "tool", "island"), ["session_id", "scope_ref", "tool"])


def groups_of(placed: DataFrame) -> DataFrame:
    """The groups of ``merged_groups`` from events with tags and island."""
    flags = placed.select("session_id", "scope_ref", "island", "created_at", "id", F.explode_outer("tags").alias("tag"))
    # Tags are a fixed set of eight, so their union stays small however many events a group has.
    g = flags.groupBy("session_id", "scope_ref", "island").agg(F.count_distinct("id").alias("n_events"), F.sort_array(F.collect_set("tag")).alias("tags"), F.min("created_at").alias("first_at"), F.min_by("id", F.struct("created_at", "id")).alias("lead_id"))
    n = F.col("n_events")
    g = g.withColumn("tier", tier(n, F.col("tags")))
    return g.withColumn("confidence", confidence_by_tier(F.col("tier"), n)).withColumn("importance", importance_by_tags(F.col("tags"), n))


def actions(events: DataFrame) -> DataFrame:
    """(action, n_events): discarded noise, latent (tier 3) and materialized events."""
    quiet = events.where(noise()).agg(F.lit("discarded").alias("action"), F.count("*").alias("n_events"))
    rest = merged_groups(events.where(~noise())).groupBy(F.when(F.col("tier") == 3, "latent").otherwise("materialized").alias("action")).agg(F.sum("n_events").alias("n_events"))
    return quiet.unionByName(rest)


def heuristic_sessions(events: DataFrame, hours: int = 6) -> DataFrame:
    """``events`` with ``visit``: a new one in a session where the gap exceeds ``hours``."""
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    gap = F.col("created_at") > F.lag("created_at").over(w) + F.expr(f"interval {hours} hours")
    return events.withColumn("_new", F.when(gap, 1).otherwise(0)).withColumn("visit", F.sum("_new").over(w).cast("int")).drop("_new")


def reconcile(memories: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups with the first at-risk memory (by verification, confidence, id) of their scope; each group is claimed once."""
    from .selection import bounded_broadcast

    m = memories.select(F.col("id").alias("memory_id"), "scope_glob", "last_verified_at", "confidence")
    m = m.withColumn("scope_ref", F.regexp_replace("scope_glob", r"/\*\*$", ""))
    both = groups.join(bounded_broadcast(m.groupBy("scope_ref").agg(F.min_by("memory_id", F.struct(F.coalesce(F.unix_micros(F.col("last_verified_at").cast("timestamp")), F.lit(0)), "confidence", "memory_id")).alias("memory_id"))), "scope_ref", "left")
    return both
