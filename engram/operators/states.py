"""The evidence state machine: claims of at-risk memories, stale sweep, grouping, candidates and end states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import confidence_by_tier
from ..functions.text import signal_tags
from . import evidence as ev
from .ordered import Save

#: Days after which an unmatched memory is stale, and what a match adds to its confidence.
STALE_DAYS, REINFORCED, MOST_CONFIDENT = 14, 0.05, 0.99
#: Lifecycle triggers of a candidate by type, and how its summary begins.
TRIGGERS = {"workflow": "before_model,after_tool", "pitfall": "before_tool", "policy": "before_tool,before_model", "architecture_constraint": "session_start,before_model", "decision": "session_start,before_model"}
SUMMARIES = {"pitfall": "Pitfall around", "policy": "Policy for", "architecture_constraint": "Architecture constraint for", "decision": "Decision for", "workflow": "Workflow for"}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def derived_glob(scope: Column) -> Column:
    """A file's own path, or everything below a folder."""
    return F.when(scope.rlike(r"\.[^./]+$"), scope).when(scope.endswith("/"), F.concat(scope, F.lit("**/*"))).otherwise(F.concat(scope, F.lit("/**/*")))


def matching_globs(scope: Column) -> Column:
    """All globs that match a scope hierarchically: itself, its derived glob, everything, and everything below each of its folders."""
    parts = F.split(scope, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/**/*")))
    return F.array_distinct(F.concat(F.array(scope, derived_glob(scope), F.lit("**/*")), above))


def claims(events: DataFrame, at_risk: DataFrame) -> DataFrame:
    """``events`` (id, type, scope_ref, ...) with ``memory_id``: the first at-risk memory of their type and scope, or null.

    ``at_risk``: id, type, scope_glob, last_verified_at, confidence. Memories claim in the order of last verification (never first),
    confidence and id, so an event goes to the first that matches. Scopes are matched by equality with the globs that a scope fits.
    """
    verified = F.coalesce(F.unix_micros(F.col("last_verified_at").cast("timestamp")), F.lit(-(2**62)))
    first = at_risk.groupBy("type", F.col("scope_glob").alias("glob")).agg(F.min(F.struct(verified.alias("v"), "confidence", "id")).alias("m"))
    keys = events.select("type", "scope_ref").distinct().withColumn("glob", F.explode(matching_globs(F.col("scope_ref"))))
    won = keys.join(first, ["type", "glob"]).groupBy("type", "scope_ref").agg(F.min("m").alias("m")).select("type", "scope_ref", F.col("m.id").alias("memory_id"))
    return events.join(won, ["type", "scope_ref"], "left")


def judged(claimed: DataFrame) -> DataFrame:
    """(memory_id, n_events, verified_at, contradicted) of the memories that claimed events (columns tags, created_at, contradiction)."""
    g = claimed.where("memory_id is not null").select("memory_id", "id", "created_at", "contradiction", F.explode_outer("tags").alias("tag")).groupBy("memory_id")
    out = g.agg(F.count_distinct("id").alias("n_events"), F.max("created_at").alias("verified_at"), F.bool_or("contradiction").alias("flagged"), F.collect_set("tag").alias("tags"))  # at most eight tags
    has = lambda t: F.array_contains("tags", t)
    against = F.col("flagged") | (has("decision_signal") & has("temporal_cue")) | (has("explicit_marker") & has("temporal_cue"))
    return out.select("memory_id", "n_events", "verified_at", against.alias("contradicted"))


def reconcile(at_risk: DataFrame, judgement: DataFrame, as_of: str) -> DataFrame:
    """(id, outcome, n_events, confidence): reinforced, contradicted, stale, or kept, for each at-risk memory."""
    old = F.coalesce("last_verified_at", "updated_at", "created_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {STALE_DAYS} days")
    rows = at_risk.join(judgement.withColumnRenamed("memory_id", "id"), "id", "left")
    outcome = F.when(F.col("contradicted"), "contradicted").when(F.col("contradicted").isNotNull(), "reinforced").when(old, "stale").otherwise("kept")
    better = F.when(F.col("contradicted") == F.lit(False), F.least(F.lit(MOST_CONFIDENT), F.col("confidence") + REINFORCED)).otherwise(F.col("confidence"))
    return rows.select("id", outcome.alias("outcome"), F.coalesce("n_events", F.lit(0)).alias("n_events"), better.alias("confidence"))


def grouped(claimed: DataFrame, judgement: DataFrame, save: Save = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Events that go on to be grouped, each with its group, and the groups with tier, tags, lead and targets.

    Events of a contradicted memory stay, with that memory as a target; those of a reinforced one are done with. A group of tier 3 with
    targets counts as tier 2. ``save`` keeps the events that go on, as their groups, leads, lines and tools all read them.
    """
    marked = claimed.join(judgement.select("memory_id", "contradicted"), "memory_id", "left").where("contradicted is null or contradicted")
    placed = save(ev.placed(marked))
    groups = ev.groups_of(placed).select("session_id", "scope_ref", "island", "n_events", "tags", "tier", "confidence", "importance", "lead_id")
    aimed = placed.groupBy("session_id", "scope_ref", "island").agg(F.count_distinct("memory_id").alias("n_targets"))
    groups = groups.join(aimed, ["session_id", "scope_ref", "island"])
    groups = groups.withColumn("tier", F.when((F.col("n_targets") > 0) & (F.col("tier") == 3), 2).otherwise(F.col("tier")))
    return placed, groups.withColumn("confidence", confidence_by_tier(F.col("tier"), F.col("n_events")))


def deterministic_id(seed: Column) -> Column:
    """A version-5 style UUID from the SHA-256 of ``seed``."""
    h = F.sha2(seed, 256)
    at = lambda a, n: F.substring(h, a, n)
    low = lambda a, n, mask, mark: F.lower(F.hex(F.conv(at(a, n), 16, 10).cast("long").bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(mark))))
    return F.concat_ws("-", at(1, 8), at(9, 4), F.concat(low(13, 2, 0x0F, 0x50), at(15, 2)), F.concat(low(17, 2, 0x3F, 0x80), at(19, 2)), at(21, 12))


def materialised(events: DataFrame, groups: DataFrame, existing: DataFrame, lines: int = 20) -> DataFrame:
    """Candidates from groups of tier 1 and 2: id, type, summary, details, scope_glob, triggers, tools, confidence, importance, action.

    ``existing``: id, summary, relevant_tools. Groups with the same id update one memory, the later group last, so each sees the summary
    that the one before it wrote (the same text, as it follows from the id's parts). The details list the first ``lines`` events of the
    group, which bounds what is gathered for a row.
    """
    key = ["session_id", "scope_ref", "island"]
    lead = events.select(F.col("id").alias("lead_id"), "type", "topic", F.col("created_at").alias("lead_at"))
    g = groups.where("tier <= 2").join(lead, "lead_id")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("created_at", "id"))
    text = F.concat_ws(" :: ", F.concat(F.lit("- "), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")), "tool", "title", "excerpt")
    first = events.select(*key, nth.alias("nth"), text.alias("line")).where(F.col("nth") <= lines)
    listed = first.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    tools = events.select(*key, "tool").distinct().groupBy(*key).agg(F.array_sort(F.collect_list("tool")).alias("tools"))
    g = g.join(listed, key).join(tools, key)
    g = g.withColumn("id", deterministic_id(F.concat_ws(":", F.lit("dream-candidate"), "type", "scope_ref", "topic")))
    g = g.withColumn("summary", F.concat(lookup(SUMMARIES, F.col("type")), F.lit(" "), F.substring_index("scope_ref", "/", -1), F.lit(" ("), F.col("topic"), F.lit(")")))
    order = Window.partitionBy("id").orderBy("lead_at", "lead_id")
    g = g.withColumn("nth", F.row_number().over(order)).withColumn("last", F.lead("id").over(order).isNull())
    g = g.join(existing.select("id", F.col("summary").alias("old"), "relevant_tools"), "id", "left")
    before = F.when(F.col("nth") > 1, F.col("summary")).otherwise(F.col("old"))
    head = F.when(before.isNull(), "Dream consolidation candidate built from recent evidence:").otherwise(F.concat(F.lit("Previous understanding:\n"), before, F.lit("\n\nNew evidence:")))
    union = g.select("id", F.explode(F.concat("tools", F.coalesce("relevant_tools", F.array().cast("array<string>")))).alias("tool")).distinct().groupBy("id").agg(F.array_sort(F.collect_list("tool")).alias("all_tools"))
    return g.where("last").join(union, "id").select(
        "id", "type", "summary", F.concat(head, F.lit("\n"), F.col("lines")).alias("details"), derived_glob(F.col("scope_ref")).alias("scope_glob"), lookup(TRIGGERS, F.col("type")).alias("triggers"),
        F.array_join("all_tools", ",").alias("tools"), "confidence", "importance", F.when(before.isNull(), "created").otherwise("updated").alias("action"),
    )


def end_states(all_events: DataFrame, claimed: DataFrame, judgement: DataFrame, placed: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, state): discarded noise, materialized or latent events after a run; others keep their status."""
    quiet = all_events.where(ev.noise()).select("id", F.lit("discarded").alias("state"))
    done = claimed.join(judgement.where("not contradicted").select("memory_id"), "memory_id").select("id", F.lit("materialized").alias("state"))
    key = ["session_id", "scope_ref", "island"]
    rest = placed.join(groups.select(*key, "tier"), key).select("id", F.when(F.col("tier") == 3, "latent").otherwise("materialized").alias("state"))
    return quiet.unionByName(done).unionByName(rest)


def evidence_window(events: DataFrame, now: str, hours: int = 24, most: int = 50) -> DataFrame:
    """The first ``most`` processable events of the last ``hours``, in order of time."""
    since = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {hours} hours")
    rows = events.where(F.col("status").isin("pending", "retained") & (F.col("created_at") >= since) & (F.col("created_at") <= F.lit(now).cast("timestamp_ntz")))
    return rows.orderBy("created_at", "id").limit(most)


def with_signals(events: DataFrame) -> DataFrame:
    """Events with type, topic, tags and a contradiction flag (none of its own in these tables)."""
    return ev.enriched(events).withColumn("tags", signal_tags(F.col("excerpt"), F.col("args_json"))).withColumn("contradiction", F.lit(False))
