"""Activation modes: default (staged), startup, temporal and cross-session, for many requests at once.

All modes end in a greedy fill of at most ``MAX_MEMORIES`` rows and ``MAX_BYTES`` bytes, which depends on the order and is folded over
an array for each request. Only rows that can still be chosen are gathered (see ``selection.select``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered
from .selection import MAX_BYTES, MAX_MEMORIES, QUOTAS, bounded_broadcast

#: Rows and bytes of the baseline layer; what a listed tool and a recent session add; the share a repeated prefix keeps.
BASELINE_ROWS, BASELINE_BYTES = 2, 2048
TOOL_BOOST, RECENT_BOOST, PREFIX_SHARE = 0.15, 0.15, 0.7
CHOSEN = "array<struct<id:string,score:double,bytes:int,rank:int>>"


def total_order(score: Column) -> Column:
    """A struct that sorts ascending by score, importance, confidence, updated, created (all descending) and id."""
    micros = lambda c: -F.unix_micros(F.col(c).cast("timestamp"))
    return F.struct((-F.round(score, 12)).alias("k0"), (-F.col("importance")).alias("k1"), (-F.col("confidence")).alias("k2"), micros("updated_at").alias("k3"), micros("created_at").alias("k4"), F.col("id").alias("k5"))


def fill(rows: DataFrame, order: list[str], most: int = MAX_MEMORIES, limit: int = MAX_BYTES) -> DataFrame:
    """Greedy fill of each request: ``rows`` (request_id, id, score, bytes, stage and the columns ``order``), in the order of stage and ``order``.

    Stage 0 is the baseline layer with its own limits. A row that was chosen in an earlier stage is passed over. Of rows of one stage
    and size no more than twice ``most`` are gathered, as that many would be chosen or were chosen before.
    Returns request_id, id, score, bytes, rank.
    """
    rows = rows.where(F.col("bytes") <= limit).withColumn("key", F.struct("stage", *order))
    few = Window.partitionBy("request_id", "stage", "bytes").orderBy("key")
    rows = rows.withColumn("nth", F.row_number().over(few)).where(F.col("nth") <= 2 * most)
    start = F.struct(F.lit(0).alias("used"), F.from_json(F.lit("[]"), CHOSEN).alias("out"))

    def step(state: Column, x: Column) -> Column:
        n = F.size(state["out"])
        ok = F.when(x["key"]["stage"] == 0, (n < BASELINE_ROWS) & (state["used"] + x["bytes"] <= BASELINE_BYTES)).otherwise((n < most) & (state["used"] + x["bytes"] <= limit))
        ok = ok & ~F.exists(state["out"], lambda y: y["id"] == x["id"])
        new = F.struct(x["id"].alias("id"), x["score"].alias("score"), x["bytes"].alias("bytes"), (n + 1).alias("rank"))
        return F.when(ok, F.struct((state["used"] + x["bytes"]).alias("used"), F.concat(state["out"], F.array(new)).alias("out"))).otherwise(state)

    folded = rows.groupBy("request_id").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("key", "id", "score", "bytes"))), start, step, lambda s: s["out"]).alias("out"))
    return folded.select("request_id", F.inline("out"))


def staged(rows: DataFrame, retrieved: DataFrame) -> DataFrame:
    """The first fill of default mode: baseline, then what was retrieved, then the rows that pass all gates.

    ``rows``: each request with each eligible memory (request_id, id, activation_class, base, boosted, bytes, passes and the columns of
    the order); ``retrieved``: request_id, id, score (of activation), rank.
    """
    key = total_order(F.col("base"))
    place = F.struct(F.lit(0).alias("at"), key.alias("key"))
    cols = ["request_id", "id", "bytes"]
    base = rows.where("activation_class = 'baseline'").select(*cols, F.col("base").alias("score"), F.lit(0).alias("stage"), place.alias("place"))
    few = bounded_broadcast(retrieved.select("request_id", "id", F.col("score").alias("found"), F.col("rank").alias("found_at")))  # as many rows as are wanted
    found = rows.join(few, ["request_id", "id"])
    found = found.select(*cols, F.col("found").alias("score"), F.lit(1).alias("stage"), F.struct(F.col("found_at").alias("at"), key.alias("key")).alias("place"))
    scoped = rows.where("passes").select(*cols, F.col("boosted").alias("score"), F.lit(2).alias("stage"), place.alias("place"))
    return fill(base.unionByName(found).unionByName(scoped), ["place"])


def balanced(chosen: DataFrame, explore: DataFrame, most: int = MAX_MEMORIES, limit: int = MAX_BYTES) -> DataFrame:
    """The second pass of default mode: (request_id, id, rank, how) with prefix penalty, type quotas, exploration and backfill.

    ``chosen``: rows of ``staged`` with type, activation_class, scope_glob, has_query and the columns of the order; ``explore``: request_id,
    id, bytes, nth: the most recently updated rows that pass (at least ``most`` + 1 of them). ``how``: core, exploration, backfill,
    or for rows left out: quota, budget.
    """
    prefix = F.split(F.regexp_replace("scope_glob", r"^(\./|/)", ""), "/")[0]
    again = F.row_number().over(Window.partitionBy("request_id", "prefix").orderBy("k")) > 1  # at most ``most`` rows a request
    rows = chosen.withColumn("prefix", prefix).withColumn("k", total_order(F.col("score")))
    rows = rows.withColumn("score", F.when((F.col("prefix") != "") & again, F.col("score") * PREFIX_SHARE).otherwise(F.col("score")))
    item = F.struct(total_order(F.col("score")).alias("key"), "id", "type", "bytes", (F.col("activation_class") == "baseline").alias("baseline"))
    listed = rows.groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("has_query").alias("has_query"))
    fresh = explore.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "bytes"))).alias("fresh"))
    listed = listed.join(fresh, "request_id", "left")
    quota = F.create_map(*(F.lit(v) for kv in QUOTAS.items() for v in kv))
    out_type = "array<struct<id:string,type:string,bytes:int,how:string>>"
    core = F.when(F.col("has_query"), F.lit(most)).otherwise(F.lit(most - 1))
    in_ = lambda out: F.filter(out, lambda y: y["how"] == "core")

    def step(state: Column, x: Column) -> Column:
        kept = in_(state["out"])
        full = F.size(kept) >= core
        over = ~x["baseline"] & (F.size(F.filter(kept, lambda y: y["type"] == x["type"])) >= F.coalesce(F.element_at(quota, x["type"]), F.lit(2)))
        big = state["used"] + x["bytes"] > limit
        how = F.when(full, "rest").when(over, "quota").when(big, "budget").otherwise("core")
        new = F.struct(x["id"].alias("id"), x["type"].alias("type"), x["bytes"].alias("bytes"), how.alias("how"))
        return F.struct((state["used"] + F.when(how == "core", x["bytes"]).otherwise(0)).alias("used"), F.concat(state["out"], F.array(new)).alias("out"))

    start = F.struct(F.lit(0).alias("used"), F.from_json(F.lit("[]"), out_type).alias("out"))
    listed = listed.withColumn("fold", F.aggregate("items", start, step))
    listed = listed.select("request_id", "has_query", F.col("fold.used").alias("used"), F.col("fold.out").alias("out"), in_(F.col("fold.out")).alias("kept"), "fresh")
    free = F.filter("fresh", lambda x: ~F.exists("kept", lambda y: y["id"] == x["id"]))
    pick = F.get(free, F.lit(0))
    listed = listed.withColumn("pick", F.when(~F.col("has_query") & (F.size("kept") < most) & (F.col("used") + pick["bytes"] <= limit), pick["id"]))
    spare = F.filter("out", lambda x: (x["how"] != "core") & (F.col("used") + x["bytes"] <= limit))
    listed = listed.withColumn("back", F.when(F.col("pick").isNull() & (F.size("kept") < most), F.get(spare, F.lit(0))["id"]))
    final = F.concat(F.transform("kept", lambda x: F.struct(x["id"].alias("id"), F.lit("core").alias("how"))), F.array_compact(F.array(F.when(F.col("pick").isNotNull(), F.struct(F.col("pick").alias("id"), F.lit("exploration").alias("how"))), F.when(F.col("back").isNotNull(), F.struct(F.col("back").alias("id"), F.lit("backfill").alias("how"))))))
    left = F.transform(F.filter("out", lambda x: x["how"].isin("quota", "budget")), lambda x: F.struct(x["id"].alias("id"), F.lit(0).alias("rank"), x["how"].alias("how")))
    ranked = F.transform(final, lambda x, i: F.struct(x["id"].alias("id"), (i + 1).alias("rank"), x["how"].alias("how")))
    return listed.select("request_id", F.inline(F.concat(ranked, left)))


def with_start(chosen: DataFrame, summaries: DataFrame, save: ordered.Save) -> DataFrame:
    """``chosen`` (request_id, session_id, ended_at, ...) with ``start_at``: the creation of the summary before it, null for the first.

    Summaries are put in order once (``ordered.previous``); a session finds its start by its id.
    """
    before = ordered.previous(summaries.select("created_at", "session_id"), ["created_at", "session_id"], ["created_at"], save)
    return chosen.join(before.select("session_id", F.col("prev.created_at").alias("start_at")), "session_id", "left")


def in_windows(rows: DataFrame, chosen: DataFrame, save: ordered.Save, parts: int = 1024) -> DataFrame:
    """``rows`` (request_id, created_at, ...) that were created in one of the request's windows: later than ``start_at``, up to ``ended_at``.

    The time that the windows span is cut into ``parts`` bins; a window is listed in each bin that it touches, a row is in one, and
    they are joined by request and bin. A window without a start reaches to the bin before all others.
    """
    w = save(chosen)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = w.agg(F.min(F.least(F.coalesce(micros("start_at"), micros("ended_at")), micros("ended_at"))).alias("low"), F.max(micros("ended_at")).alias("high")).first()
    low, width = span.low or 0, max(1, -(-((span.high or 0) - (span.low or 0) + 1) // parts))
    bin_ = lambda c: F.greatest(F.lit(-1), F.floor((micros(c) - F.lit(low)) / F.lit(width))).cast("long")
    w = w.withColumn("_bin", F.explode(F.sequence(F.coalesce(bin_("start_at"), F.lit(-1).cast("long")), bin_("ended_at"))))
    inside = (F.col("w.start_at").isNull() | (F.col("r.created_at") > F.col("w.start_at"))) & (F.col("r.created_at") <= F.col("w.ended_at"))
    r = rows.withColumn("_bin", bin_("created_at")).alias("r")
    both = r.join(bounded_broadcast(w).alias("w"), (F.col("r.request_id") == F.col("w.request_id")) & (F.col("r._bin") == F.col("w._bin"))).where(inside)
    return both.select("r.*", *(F.col(f"w.{c}") for c in chosen.columns if c != "request_id")).drop("_bin")
