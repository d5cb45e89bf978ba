"""Activation: gates, order, and budgeted selection for many requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import memory_score, payload_bytes
from . import globs

#: Limits and quotas of a selection.
MAX_MEMORIES, MAX_BYTES = 10, 8192
QUOTAS = {"policy": 3, "workflow": 3, "pitfall": 2, "architecture_constraint": 1, "decision": 1}
#: Rounds of a round-robin that are summed in one task.
ROUNDS = 4096
ORDER = ("score", "importance", "confidence", "updated_at", "created_at")


def bounded_broadcast(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def gates(memories: DataFrame, as_of: str, include_superseded: bool = False) -> DataFrame:
    """``memories`` with ``kind``: status_inactive, ttl_expired or null (kept)."""
    kept = ["active", "superseded"] if include_superseded else ["active"]
    return memories.withColumn("kind", F.when(~F.col("status").isin(kept), "status_inactive").when(F.col("ttl_expires_at") < F.lit(as_of).cast("timestamp_ntz"), "ttl_expired"))


def candidates(memories: DataFrame, requests: DataFrame, as_of: str) -> DataFrame:
    """Every request with every memory that passes trigger, scope and tool gates, scored. Both gates are equality joins (``globs``)."""
    m = gates(memories, as_of).where("kind is null").withColumn("base", memory_score(as_of)).withColumn("bytes", payload_bytes())
    m = m.select("id", "type", "triggers", "scope_glob", "activation_class", "importance", "confidence", "updated_at", "created_at", "relevant_tools", "base", "bytes")
    r = requests.select("request_id", "trigger", "scope_ref", "tool")
    tool = F.col("relevant_tools").isNull() | F.coalesce(F.array_contains("relevant_tools", F.col("tool")), F.lit(False))
    boost = F.when((F.col("trigger") == "before_tool") & F.col("relevant_tools").isNotNull() & tool, 0.15).otherwise(0.0)
    return globs.in_scope(m, r).where(tool).withColumn("score", F.col("base") + boost).drop("triggers", "relevant_tools", "base")


def sort_key() -> Column:
    """A struct that sorts ascending in the total order: score, importance, confidence, updated, created descending, then id."""
    micros = lambda c: -F.unix_micros(F.col(c).cast("timestamp"))
    return F.struct((-F.col("score")).alias("k0"), (-F.col("importance")).alias("k1"), (-F.col("confidence")).alias("k2"), micros("updated_at").alias("k3"), micros("created_at").alias("k4"), F.col("id").alias("k5"))


def penalise_prefix(rows: DataFrame, factor: float = 0.7) -> DataFrame:
    """All but the best row of a request's scope prefix get ``factor`` of their score; an empty prefix is exempt."""
    prefix = F.split(F.regexp_replace("scope_glob", r"^(\./|/)", ""), "/")[0]
    rows = rows.withColumn("prefix", prefix)
    # The best row of a prefix is an aggregate: no task sorts a prefix that half of all memories share.
    best = rows.groupBy("request_id", "prefix").agg(F.min_by("id", sort_key()).alias("best_id"))
    out = rows.join(best, ["request_id", "prefix"])
    return out.withColumn("score", F.when((F.col("prefix") != "") & (F.col("id") != F.col("best_id")), F.col("score") * factor).otherwise(F.col("score"))).drop("best_id")


def select(rows: DataFrame, max_memories: int = MAX_MEMORIES, max_bytes: int = MAX_BYTES, quotas: dict[str, int] | None = None) -> DataFrame:
    """Greedy selection by request: in order, skip what does not fit any more, stop at ``max_memories``.

    Returns ``rows`` columns request_id, id, type, score, bytes and rank. Only rows that can be chosen are gathered: a row
    before which as many rows of the same size (and type, with ``quotas``) come as may be chosen is never chosen, as those
    would have fitted, too. That leaves at most ``max_memories`` rows of each size up to ``max_bytes``, whatever the input.
    """
    keys = ["request_id", "bytes", *(["type"] if quotas else [])]
    rows = rows.where(F.col("bytes") <= max_bytes).withColumn("key", sort_key())
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("key"))).where(F.col("_n") <= max_memories)
    item = F.struct("key", "id", "type", "score", "bytes")
    chosen_type = "array<struct<id:string,type:string,score:double,bytes:int,rank:int>>"
    start = F.struct(F.lit(0).alias("used"), F.from_json(F.lit("[]"), chosen_type).alias("out"))

    def step(state: Column, x: Column) -> Column:
        ok = (F.size(state["out"]) < max_memories) & (state["used"] + x["bytes"] <= max_bytes)
        if quotas:
            mine = F.size(F.filter(state["out"], lambda y: y["type"] == x["type"]))
            limit = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in quotas.items() for v in kv)), x["type"]), F.lit(2))
            ok = ok & (mine < limit)
        new = F.struct(x["id"].alias("id"), x["type"].alias("type"), x["score"].alias("score"), x["bytes"].alias("bytes"), (F.size(state["out"]) + 1).alias("rank"))
        return F.when(ok, F.struct((state["used"] + x["bytes"]).alias("used"), F.concat(state["out"], F.array(new)).alias("out"))).otherwise(state)

    folded = rows.groupBy("request_id").agg(F.aggregate(F.array_sort(F.collect_list(item)), start, step, lambda s: s["out"]).alias("out"))
    return folded.select("request_id", F.inline("out"))


def interleave(rows: DataFrame, group: str, order: list, cap: int | None = None) -> DataFrame:
    """Round-robin over the groups of a request, groups by first appearance, at most ``cap`` rows of each; adds ``rank``.

    Rows are numbered within their group, which gives their round. A row's rank is the number of rows in earlier rounds, a prefix sum over
    a small row a round, and its place among the groups that have that round.
    """
    rows = rows.withColumn("_key", F.struct(*order))
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("request_id", group).orderBy("_key")))
    if cap:
        rows = rows.where(F.col("_rn") <= cap)
    first = rows.where("_rn = 1").select("request_id", group, F.col("_key").alias("_first"))
    rounds = rows.groupBy("request_id", "_rn").agg(F.count("*").alias("_n"))
    # In two steps, as a request may have as many rounds as its largest group has rows.
    rounds = rounds.withColumn("_block", F.floor(F.col("_rn") / ROUNDS))
    blocks = rounds.groupBy("request_id", "_block").agg(F.sum("_n").alias("_all"))
    upto = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = blocks.withColumn("_before", zero(F.sum("_all").over(upto("request_id").orderBy("_block")))).drop("_all")
    rounds = rounds.withColumn("_own", zero(F.sum("_n").over(upto("request_id", "_block").orderBy("_rn")))).join(blocks, ["request_id", "_block"])
    rounds = rounds.select("request_id", "_rn", (F.col("_before") + F.col("_own")).alias("_ahead"))
    out = rows.join(first, ["request_id", group]).join(rounds, ["request_id", "_rn"])
    place = F.row_number().over(Window.partitionBy("request_id", "_rn").orderBy("_first"))
    return out.withColumn("rank", (F.col("_ahead") + place).cast("int")).drop("_key", "_rn", "_first", "_ahead")


def disclosure(rank: Column, activation_class: Column) -> Column:
    return F.when(activation_class == "baseline", "full").when(rank <= 5, "full").when(rank <= 8, "summary").otherwise("hint")


def conflicts(memories: DataFrame) -> DataFrame:
    """Groups of active memories with the same type, scope and triggers: size and the earliest as root."""
    g = memories.where("status = 'active'").groupBy("type", "scope_glob", F.array_join("triggers", ",").alias("triggers"))
    return g.agg(F.count("*").alias("n"), F.min_by("id", F.struct("created_at", "id")).alias("root_id")).where("n > 1")


def policy_warnings(rules: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, rule_code) of rules whose trigger equals the request's and whose glob matches its scope."""
    p = rules.select("rule_code", F.array("trigger_kind").alias("triggers"), F.col("rule_glob").alias("scope_glob"))
    return globs.in_scope(p, requests.select("request_id", "trigger", "scope_ref")).select("request_id", "rule_code")
