"""Session summaries from bounded slots: topics, tools, types, latest events and the best excerpts of each type.

Every slot is a grouping or a ranking that keeps its first few rows in each task before anything is shuffled, so a session with a third of all
events sends a few rows a task. The texts are then put together from one row a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Store
from .ordered import Save

#: Sizes of the slots and texts, the order of types, and when a session gets or keeps a summary.
TYPES = ("workflow", "pitfall", "policy", "decision", "architecture_constraint")
SHORT, MEDIUM, TOPICS, SOURCES, SNIPPETS, SNIPPET = 400, 1000, 5, 20, 2, 120
LEAST_EVENTS, FRESH_MINUTES = 3, 30
SUMMARIES = "summaries"


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def cut(text: Column, most: int) -> Column:
    """At most ``most`` characters, with dots for what is left out."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


def _label(kind: Column) -> Column:
    return F.replace(kind, F.lit("_"), F.lit(" "))


def _first(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= most)


def _list(rows: DataFrame, value: str, name: str) -> DataFrame:
    """One row a session with ``name``: the values in the order of ``nth``; a session has a few."""
    return rows.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col(value).alias("v")))), lambda x: x["v"]).alias(name))


def summarise(events: DataFrame, save: Save = lambda df: df) -> DataFrame:
    """(session_id, event_count, tools, topics, types, source_ids, short, medium) of each session of ``events``.

    ``events``: session_id, id, created_at, tool, type, topic, title, excerpt, salience, novelty, boost. Topics are counted without regard to
    case, by frequency and then by first appearance. Excerpts are the best by salience + novelty + boost, then the latest, without repeats; an empty one gives the
    title. ``medium`` has as many whole lines as fit. Every slot reads the events; ``save`` keeps what they need of them, so types, topics and texts are
    worked out once.
    """
    text = F.when(_flat(F.col("excerpt")) != "", cut(_flat(F.col("excerpt")), SNIPPET)).otherwise(cut(_flat(F.col("title")), SNIPPET))
    score = F.round(F.col("salience") + F.col("novelty") + F.col("boost"), 9)
    e = save(events.select("session_id", "id", "created_at", _flat(F.col("tool")).alias("tool"), "type", _flat(F.col("topic")).alias("topic"), text.alias("text"), score.alias("score")))
    counted = e.groupBy("session_id").agg(F.count("*").alias("event_count"), *(F.sum((F.col("type") == t).cast("int")).alias(t) for t in TYPES))
    by_topic = e.where("topic <> ''").groupBy("session_id", F.lower("topic").alias("key")).agg(F.count("*").alias("n"), F.min(F.struct("created_at", "id", "topic")).alias("seen"))
    topics = _list(_first(by_topic, ["session_id"], [F.desc("n"), F.col("seen")], TOPICS).withColumn("topic", F.col("seen.topic")), "topic", "topics")
    tools = e.where("tool <> ''").select("session_id", "tool").distinct().groupBy("session_id").agg(F.array_sort(F.collect_list("tool")).alias("tools"))  # as many as there are tools
    latest = _list(_first(e, ["session_id"], [F.desc("created_at"), F.desc("id")], SOURCES), "id", "source_ids")
    said = e.where("text <> ''").groupBy("session_id", "type", "text").agg(F.max(F.struct("score", "created_at", "id")).alias("best"))
    best = _first(said, ["session_id", "type"], [F.desc("best")], SNIPPETS).groupBy("session_id", "type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), " | ").alias("line"))
    lines = best.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("type", "line"))).alias("lines"))  # five types
    one = counted
    for other in (topics, tools, latest, lines):
        one = one.join(other, "session_id", "left")
    kinds = F.filter(F.array(*(F.struct((-F.col(t)).alias("low"), F.lit(t.replace("_", " ")).alias("label"), F.lit(t).alias("type"), F.col(t).alias("n")) for t in TYPES)), lambda x: x["n"] > 0)
    one = one.withColumn("types", F.array_sort(kinds))
    some = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.array_join(c, ", ")).otherwise("none")
    counts = F.array_join(F.transform(F.slice("types", 1, 3), lambda x: F.concat(x["label"], F.lit(" ("), x["n"], F.lit(")"))), ", ")
    listed = F.concat(F.lit("[Session] "), F.col("event_count"), F.lit(" events: "), F.when(F.size("types") > 0, counts).otherwise("no strong type signal"), F.lit(". Tools: "), some("tools"), F.lit(". Topics: "), some("topics"), F.lit("."))
    head = F.array(F.concat(F.lit("Session "), F.col("session_id"), F.lit(" overview")), F.concat(F.lit("Events: "), F.col("event_count")), F.concat(F.lit("Tools: "), some("tools")), F.concat(F.lit("Topics: "), some("topics")))
    body = F.transform("types", lambda x: F.concat(x["label"], F.lit(" ("), x["n"], F.lit("): "), F.coalesce(F.col("lines")[x["type"]], F.lit("No representative excerpts."))))
    body = F.when(F.size("types") > 0, body).otherwise(F.array(F.lit("Types: no representative evidence.")))
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def add(a: Column, line: Column) -> Column:
        longer = F.when(a["text"] == "", line).otherwise(F.concat(a["text"], F.lit("\n"), line))
        over = F.struct(F.when(a["text"] == "", cut(line, MEDIUM)).otherwise(a["text"]).alias("text"), F.lit(True).alias("full"))
        return F.when(a["full"], a).when(F.length(longer) > MEDIUM, over).otherwise(F.struct(longer.alias("text"), F.lit(False).alias("full")))

    medium = F.aggregate(F.concat(head, body), start, add, lambda a: a["text"])
    return one.select("session_id", "event_count", "tools", "topics", F.transform("types", lambda x: F.struct(x["type"].alias("type"), x["n"].alias("n"))).alias("types"), "source_ids", cut(listed, SHORT).alias("short"), medium.alias("medium"))


def due(events: DataFrame, stored: DataFrame, as_of: Column) -> DataFrame:
    """The events of sessions that have enough of them and no stored summary (session_id, updated_at) of the last half hour."""
    fresh = stored.where(F.col("updated_at") > as_of - F.expr(f"interval {FRESH_MINUTES} minutes")).select("session_id")
    many = events.groupBy("session_id").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_EVENTS).select("session_id")
    return events.join(many.join(fresh, "session_id", "left_anti"), "session_id", "left_semi")


def refresh(store: Store, events: DataFrame, as_of: Column, save: Save = lambda df: df) -> int:
    """The version in which all due sessions have a new summary; ``created_at`` stays, and a vector until there is a new one."""
    base = store.head()
    stored = store.read(SUMMARIES, base)
    new = summarise(due(events, stored, as_of), save).withColumn("vector", F.lit(None).cast(stored.schema["vector"].dataType)).withColumn("created_at", as_of).withColumn("updated_at", as_of)
    return store.upsert(SUMMARIES, new.select(*stored.columns), keep=("created_at",), fill=("vector",), base=base)
