"""Lifecycle changes as new versions of the memory table, lineage by doubling, and the extraction parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import with_safety

#: What an extracted fact may be, and the keys it may have.
ACTIONS = ("create", "reinforce", "supersede", "stale")
TYPES = ("policy", "workflow", "pitfall", "architecture_constraint", "decision")
FACTS = "facts array<struct<action:string,summary:string,details:string,type:string,targetMemoryId:string,confidence:double>>"


def merged(memories: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, status, supersedes_id) after merging: ``pairs`` (source_id, target_id); a source is superseded by its target, which stays as it is.

    Pairs of a memory with itself are refused: they change nothing.
    """
    p = pairs.where("source_id != target_id").groupBy(F.col("source_id").alias("id")).agg(F.min("target_id").alias("target_id"))
    return memories.join(p, "id", "left").select("id", F.when(F.col("target_id").isNotNull(), "superseded").otherwise(F.col("status")).alias("status"), F.coalesce("target_id", "supersedes_id").alias("supersedes_id"))


def replaced(memories: DataFrame, pairs: DataFrame, status: str) -> DataFrame:
    """(id, status, supersedes_id) after ``pairs`` (old_id, new_id): the old memory gets ``status`` (superseded or stale), the new one points to it."""
    old = pairs.select(F.col("old_id").alias("id"), F.lit(True).alias("left")).distinct()
    new = pairs.groupBy(F.col("new_id").alias("id")).agg(F.min("old_id").alias("old_id"))
    rows = memories.join(old, "id", "left").join(new, "id", "left")
    return rows.select("id", F.when(F.col("left"), status).otherwise(F.col("status")).alias("status"), F.coalesce("old_id", "supersedes_id").alias("supersedes_id"))


def promotable(memories: DataFrame, least: float) -> DataFrame:
    """(id, outcome) of candidates in a batch promotion: promoted, unsafe, or low_confidence."""
    rows = with_safety(memories.where("status = 'candidate'"))
    return rows.select("id", F.when(F.col("confidence") < least, "low_confidence").when(~F.col("safe"), "unsafe").otherwise("promoted").alias("outcome"))


def ancestors(rows: DataFrame, save, most_rounds: int = 40) -> DataFrame:
    """(id, ancestor_id, depth) of all ancestors of all ``rows`` (id, supersedes_id), by doubling; a cycle ends where it would repeat.

    Each round joins the known chains with themselves, so a chain of n steps takes log2 n rounds. ``save`` cuts a round's lineage: a
    function that writes a DataFrame and reads it back, or checkpoints it. ``id`` occurs once; links to unknown ids have no ancestors.
    """
    one = rows.where("supersedes_id is not null").select("id", F.col("supersedes_id").alias("ancestor_id"), F.lit(1).alias("depth"))
    known = save(one.join(rows.select(F.col("id").alias("ancestor_id")), "ancestor_id", "left_semi").where("id != ancestor_id").select("id", "ancestor_id", "depth"))
    reach = 1
    for _ in range(most_rounds):
        ends = known.where(F.col("depth") == reach)
        far = known.select(F.col("id").alias("ancestor_id"), F.col("ancestor_id").alias("next"), F.col("depth").alias("more"))
        new = ends.join(far, "ancestor_id").select("id", F.col("next").alias("ancestor_id"), (F.col("depth") + F.col("more")).alias("depth")).where("id != ancestor_id")
        both = known.unionByName(new).groupBy("id", "ancestor_id").agg(F.min("depth").alias("depth"))
        both = save(both)
        if both.count() == known.count():
            return both
        known, reach = both, reach * 2
    raise RuntimeError("lineage did not settle")


def paths(chains: DataFrame) -> DataFrame:
    """(id, ancestor_id, depth, path): the chain from each row to each of its ancestors, as ids joined by ``>``."""
    upto = Window.partitionBy("id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    return chains.select("id", "ancestor_id", "depth", F.concat_ws(">", "id", F.array_join(F.collect_list("ancestor_id").over(upto), ">")).alias("path"))


def history(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """(id, root_id, n_ancestors, n_descendants, replaced_by): a memory's place in its lineage; ``replaced_by`` is its earliest direct successor."""
    up = chains.groupBy("id").agg(F.count("*").alias("n_ancestors"), F.max_by("ancestor_id", F.struct("depth", "ancestor_id")).alias("root_id"))
    down = chains.groupBy(F.col("ancestor_id").alias("id")).agg(F.count("*").alias("n_descendants"))
    after = rows.where("supersedes_id is not null").groupBy(F.col("supersedes_id").alias("id")).agg(F.min_by("id", F.struct("created_at", "id")).alias("replaced_by"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = rows.select("id").join(up, "id", "left").join(down, "id", "left").join(after, "id", "left")
    return out.select("id", F.coalesce("root_id", "id").alias("root_id"), zero("n_ancestors"), zero("n_descendants"), "replaced_by")


def extracted(responses: DataFrame) -> DataFrame:
    """(id, nth, action, summary, details, type, target_id, confidence): valid facts in the ``response`` texts of an extraction.

    Code fences go, the outermost braces hold the JSON; what can't be read has no facts. A fact needs a known action and a summary;
    an unknown type, an empty target or a confidence outside [0, 1] is left out.
    """
    t = F.regexp_replace(F.regexp_replace(F.trim("response"), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    t = F.when(F.trim("response").startswith("```"), t).otherwise(F.trim("response"))
    body = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    facts = responses.select("id", F.posexplode(F.from_json(body, FACTS)["facts"]).alias("nth", "f")).where(F.col("f.action").isin(*ACTIONS) & (F.length("f.summary") > 0))
    return facts.select(
        "id", "nth", "f.action", "f.summary", F.coalesce("f.details", "f.summary").alias("details"), F.when(F.col("f.type").isin(*TYPES), F.col("f.type")).alias("type"),
        F.when(F.length("f.targetMemoryId") > 0, F.col("f.targetMemoryId")).alias("target_id"), F.when(F.col("f.confidence").between(0, 1), F.col("f.confidence")).alias("confidence"),
    )


def applied(facts: DataFrame, memories: DataFrame) -> DataFrame:
    """(id, nth, action, skipped, reason): the outcome of each fact; facts that need a memory are skipped where it is missing."""
    known = memories.select(F.col("id").alias("target_id"), F.lit(True).alias("found"))
    rows = facts.join(known, "target_id", "left")
    reason = F.when(F.col("action") == "create", F.lit(None).cast("string")).when(F.col("target_id").isNull(), "No target").when(F.col("found").isNull(), "Target not found")
    return rows.select("id", "nth", "action", reason.isNotNull().alias("skipped"), reason.alias("reason"))


def confidences(facts: DataFrame, memories: DataFrame, step: float = 0.05, most: float = 0.99) -> DataFrame:
    """(id, status, confidence) of the memories that facts change: each reinforcement adds ``step``, a supersede or stale fact sets the status (the last one wins)."""
    order = F.struct("id", "nth")
    g = facts.where("target_id is not null and action <> 'create'").groupBy("target_id").agg(
        F.count(F.when(F.col("action") == "reinforce", 1)).alias("n"), F.max(F.when(F.col("action") != "reinforce", F.struct(order.alias("o"), "action"))).alias("last")
    )
    status = F.when(F.col("last.action") == "supersede", "superseded").when(F.col("last.action") == "stale", "stale").otherwise(F.col("status"))
    raised = F.when(F.col("n") > 0, F.greatest("confidence", F.least(F.lit(most), F.col("confidence") + F.col("n") * step))).otherwise(F.col("confidence"))
    return g.join(memories, g["target_id"] == memories["id"]).select("id", status.alias("status"), raised.alias("confidence"))
