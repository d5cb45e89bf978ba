"""Extraction actions applied in their order: what each fact does to the memories, and which new facts are near copies.

A fact that creates a memory is left out if a similar memory is there at that moment: one that was there before and has not been
superseded or marked stale by an earlier fact, the replacement of an earlier supersede fact, or a memory that an earlier fact created.
The first two don't depend on other creations, so for each distinct vector they are two numbers: up to which place old memories
block it, and from which place on replacements do. Of the facts between, only the first can be created, as whatever stops it stops
all later ones. What remains is the lexicographically first independent set of a similarity graph: a fact is in if no similar
earlier one is.

That set is found in rounds. In the first rounds no pair is listed: each fact learns in blocks of matrix products whether an earlier similar
fact is undecided, facts without one are in, and facts similar to these are out; this settles groups of near copies. Of the
rest, pairs are listed. A fact with a single undecided earlier neighbour has the opposite state of it, so chains are followed by
doubling and take as many steps as the logarithm of their length; other facts wait until their neighbours are settled.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import nearest

#: The confidence that a reinforcement adds, the most it reaches, and what a created memory has.
STEP, MOST, CONFIDENCE, IMPORTANCE = 0.05, 0.99, 0.7, 0.7
THRESHOLD = 0.85
NEVER = 1 << 62
Save = Callable[[DataFrame], DataFrame]


class Applied(NamedTuple):
    """outcomes (place, action, memory_id, skipped, reason), changed (id, status, confidence) and created (rows of memories)."""

    outcomes: DataFrame
    changed: DataFrame
    created: DataFrame


def _extreme(pick: Callable, later_only: bool) -> Callable:
    """For each query the ``pick`` (np.min or np.max) of the ids near it, of smaller ids only if ``later_only``."""
    none = NEVER if pick is np.min else -1

    def how(qids: list, ids: np.ndarray, near: np.ndarray) -> pd.DataFrame:
        q = np.asarray(qids)
        if later_only:
            near = near & (ids[None, :] < q[:, None])
        found = pick(np.where(near, ids[None, :], none), axis=1)
        some = found != none
        return pd.DataFrame({"query_id": q[some], "id": found[some]})

    return how


def _pairs(qids: list, ids: np.ndarray, near: np.ndarray) -> pd.DataFrame:
    q = np.asarray(qids)
    i, j = np.nonzero(near & (ids[None, :] < q[:, None]))
    return pd.DataFrame({"query_id": q[i], "id": ids[j]})


def _near(queries: DataFrame, vectors: DataFrame, least: float, how: Callable, save: Save, groups: int) -> DataFrame:
    return nearest.meet(queries.select(F.col("node").alias("query_id"), "vec"), vectors, least, how, "query_id long, id long", save, groups)


def settle(edges: DataFrame, save: Save) -> DataFrame:
    """(node, chosen) of the nodes of ``edges`` (node, earlier; earlier < node): a node is chosen if none of its earlier neighbours is."""
    edges = save(edges.distinct())
    nodes = edges.select("node").unionByName(edges.select(F.col("earlier").alias("node"))).distinct()
    known = save(nodes.join(edges.select("node").distinct(), "node", "left_anti").select("node", F.lit(True).alias("chosen")))
    while not edges.isEmpty():
        # Who has one undecided neighbour has its opposite state: (node, at, odd) points along such links, twice as far each time.
        one = edges.groupBy("node").agg(F.count("*").alias("n"), F.min("earlier").alias("at")).where("n = 1").select("node", "at", F.lit(True).alias("odd"))
        link = save(one)
        while True:
            on = link.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("odd").alias("more"))
            far = save(link.join(on, "at", "left").select("node", F.coalesce("next", "at").alias("at"), (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd"), F.col("next").isNotNull().alias("moved")))
            link, moved = far.drop("moved"), far.where("moved")
            if moved.isEmpty():
                break
        told = link.join(known.select(F.col("node").alias("at"), "chosen"), "at").select("node", (F.col("chosen") != F.col("odd")).alias("chosen"))
        state = known.unionByName(told)
        # One chosen neighbour is enough to be out; without undecided neighbours left a node is in.
        seen = edges.join(state.select(F.col("node").alias("earlier"), "chosen"), "earlier", "left")
        judged = seen.groupBy("node").agg(F.max(F.coalesce("chosen", F.lit(False))).alias("hit"), F.max(F.col("chosen").isNull()).alias("open"))
        new = judged.where("hit or not open").select("node", (~F.col("hit")).alias("chosen"))
        before, known = known, save(known.unionByName(new.unionByName(told).distinct().join(known, "node", "left_anti")))
        open_ = edges.join(known, "node", "left_anti")
        edges = save(open_.join(known.where("not chosen").select(F.col("node").alias("earlier")), "earlier", "left_anti").select("node", "earlier"))
        # Whose earlier neighbours have all turned out to be out is in.
        known = save(known.unionByName(open_.select("node").distinct().join(edges.select("node"), "node", "left_anti").withColumn("chosen", F.lit(True))))
        if known.count() == before.count():
            raise RuntimeError("the graph has an edge to a later node")
    return known


def first_of_similar(nodes: DataFrame, least: float, save: Save, groups: int = 1, block_rounds: int = 2) -> DataFrame:
    """(node) of ``nodes`` (node long, the order; vec) that no similar earlier chosen one stops."""
    open_, chosen = save(nodes), []
    for _ in range(block_rounds):
        if open_.isEmpty():
            break
        vectors = open_.select(F.col("node").alias("id"), "vec")
        waits = save(_near(open_, vectors, least, _extreme(np.min, True), save, groups).select(F.col("query_id").alias("node")).distinct())
        new = save(open_.join(waits, "node", "left_anti"))
        rest = open_.join(waits, "node", "left_semi")
        out = _near(rest, new.select(F.col("node").alias("id"), "vec"), least, _extreme(np.min, True), save, groups).select(F.col("query_id").alias("node")).distinct()
        chosen.append(new.select("node"))
        open_ = save(rest.join(out, "node", "left_anti"))
    edges = _near(open_, open_.select(F.col("node").alias("id"), "vec"), least, _pairs, save, groups).select(F.col("query_id").alias("node"), F.col("id").alias("earlier"))
    edges = save(edges)
    told = settle(edges, save)
    chosen.append(open_.select("node").join(told.where("not chosen"), "node", "left_anti"))
    out = chosen[0]
    for c in chosen[1:]:
        out = out.unionByName(c)
    return out


def created_places(facts: DataFrame, memories: DataFrame, ends: DataFrame, save: Save, least: float, groups: int) -> DataFrame:
    """(place) of the create facts that create. ``ends`` (id, end): the place at which a memory is superseded or stale, if it ever is."""
    new = facts.where("action = 'create'").select("place", "vec")
    free = new.where("vec is null").select("place")
    nodes = save(new.where("vec is not null").groupBy("vec").agg(F.min("place").alias("node")))
    old = memories.where(F.col("status").isin("active", "candidate") & F.col("vec").isNotNull()).join(ends, "id", "left").select(F.coalesce("end", F.lit(NEVER - 1)).alias("id"), "vec")
    replacements = facts.where("action = 'supersede' and found and vec is not null").select(F.col("place").alias("id"), "vec")
    until = _near(nodes, old, least, _extreme(np.max, False), save, groups).groupBy("query_id").agg(F.max("id").alias("until"))
    since = _near(nodes, replacements, least, _extreme(np.min, False), save, groups).groupBy("query_id").agg(F.min("id").alias("since"))
    held = nodes.join(until, nodes["node"] == until["query_id"], "left").drop("query_id").join(since, F.col("node") == since["query_id"], "left").drop("query_id")
    held = save(held.select("node", "vec", F.coalesce("until", F.lit(-1)).alias("until"), F.coalesce("since", F.lit(NEVER)).alias("since")))
    plain = held.where("node > until and node < since").select("node", "vec")
    # Where the first fact of a vector is stopped by a memory that goes later, the first one after that counts.
    late = new.join(held.where("node < until and until < since"), "vec").where("place > until and place < since").groupBy("vec").agg(F.min("place").alias("node"))
    return first_of_similar(plain.unionByName(late.select("node", "vec")), least, save, groups).select(F.col("node").alias("place")).unionByName(free)


def earlier_count(rows: DataFrame, key: str, parts: int = 1024) -> DataFrame:
    """``rows`` (key, place, hit) with ``n_before``: how many earlier rows of the key are hits. A hot key is cut into ranges of places, which are summed first."""
    span = rows.agg(F.min("place").alias("low"), F.greatest(F.lit(1), F.ceil((F.max("place") - F.min("place") + 1) / parts)).alias("width")).first()
    cut = rows.withColumn("_part", F.floor((F.col("place") - F.lit(span.low or 0)) / F.lit(span.width or 1)))
    sums = cut.groupBy(key, "_part").agg(F.sum(F.col("hit").cast("long")).alias("_n"))
    ahead = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    own = Window.partitionBy(key, "_part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("_own", F.coalesce(F.sum(F.col("hit").cast("long")).over(own), F.lit(0))).join(sums, [key, "_part"]).withColumn("n_before", F.col("_own") + F.col("_ahead")).drop("_part", "_own", "_ahead")


def apply_actions(facts: DataFrame, memories: DataFrame, save: Save, threshold: float = THRESHOLD, groups: int = 1) -> Applied:
    """What ``facts`` do, one after another.

    ``facts``: place (long, unique: their order), action (create, reinforce, supersede, stale), summary, details, type, target_id, confidence,
    vec. ``memories``: id, type, summary, details, scope_glob, triggers, status, activation_class, confidence, importance, vec. Facts without a
    vector are always created and stop no other; a target that is missing or unknown skips its fact. A created memory's id is ``n``
    and its place. No facts give no rows.
    """
    known = memories.select(F.col("id").alias("target_id"), F.lit(True).alias("_found"))
    held = save(facts.join(known, "target_id", "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found"))
    ends = held.where("found and action in ('supersede', 'stale')").groupBy(F.col("target_id").alias("id")).agg(F.min("place").alias("end"))
    made = save(created_places(held, memories, ends, save, threshold, groups).withColumn("made", F.lit(True)))
    new_id = F.concat(F.lit("n"), F.lpad(F.col("place").cast("string"), 19, "0"))
    rows = held.join(made, "place", "left")
    reason = F.when((F.col("action") == "create") & F.col("made").isNull(), "Duplicate").when(F.col("action") == "create", F.lit(None).cast("string"))
    reason = reason.when(F.col("target_id").isNull(), "No target").when(~F.col("found"), "Target not found")
    own = F.when(F.col("action").isin("create", "supersede"), new_id).otherwise(F.col("target_id"))
    outcomes = rows.withColumn("reason", reason).select("place", "action", F.when(F.col("reason").isNull(), own).otherwise(F.when(F.col("action") != "create", F.col("target_id"))).alias("memory_id"), F.col("reason").isNotNull().alias("skipped"), "reason")

    acts = held.where("found and action <> 'create'")
    g = acts.groupBy("target_id").agg(F.sum((F.col("action") == "reinforce").cast("int")).alias("n"), F.max(F.when(F.col("action") != "reinforce", F.struct("place", "action"))).alias("last"))
    status = F.when(F.col("last.action") == "supersede", "superseded").when(F.col("last.action") == "stale", "stale").otherwise(F.col("status"))
    raised = lambda n: F.when(n > 0, F.least(F.lit(MOST), F.col("confidence") + n * STEP)).otherwise(F.col("confidence"))
    changed = memories.join(g, memories["id"] == g["target_id"]).select("id", status.alias("status"), raised(F.col("n")).alias("confidence"))

    blank = held.join(made, "place", "left_semi").select(
        new_id.alias("id"), F.coalesce("type", F.lit("workflow")).alias("type"), "summary", "details", F.lit("**/*").alias("scope_glob"), F.array(F.lit("before_model")).alias("triggers"),
        F.lit("candidate").alias("status"), F.lit("scoped").alias("activation_class"), F.coalesce("confidence", F.lit(CONFIDENCE)).alias("confidence"), F.lit(IMPORTANCE).alias("importance"), F.lit(None).cast("string").alias("supersedes_id"),
    )
    over = earlier_count(acts.withColumn("hit", F.col("action") == "reinforce"), "target_id").where("action = 'supersede'")
    over = over.select("place", "target_id", F.col("summary").alias("s"), F.col("details").alias("d"), F.col("type").alias("t"), F.col("confidence").alias("c"), "n_before")
    old = memories.select(F.col("id").alias("target_id"), "type", "scope_glob", "triggers", "activation_class", "confidence", "importance")
    replaced = over.join(old, "target_id").select(
        new_id.alias("id"), F.coalesce("t", "type").alias("type"), F.col("s").alias("summary"), F.col("d").alias("details"), "scope_glob", "triggers", F.lit("candidate").alias("status"), "activation_class",
        F.coalesce(F.col("c"), raised(F.col("n_before"))).alias("confidence"), "importance", F.col("target_id").alias("supersedes_id"),
    )
    return Applied(outcomes, changed, blank.unionByName(replaced))
