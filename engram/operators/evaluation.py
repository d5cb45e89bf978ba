"""Evaluation of retrieval and of answers: leaks, coverage, votes, oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that don't count as key terms of an answer.
STOP = (
    "that", "this", "with", "from", "have", "been", "were", "they", "their", "about", "which", "when", "what", "than", "also", "into", "only", "some",
    "such", "each", "more", "used", "using", "based", "after", "before", "between",
)


def key_terms(answer: Column) -> Column:
    """Distinct words of at least four characters that aren't stop words."""
    words = F.split(F.regexp_replace(F.lower(answer), r"[^A-Za-z0-9_\s\-.]", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*STOP)))


def oracle(rows: DataFrame, share: float = 0.4) -> DataFrame:
    """(id, matched, total, hit): key terms of ``answer`` that are substrings of ``context``; a hit has at least ``share`` of them."""
    t = rows.select("id", key_terms(F.coalesce("answer", F.lit(""))).alias("terms"), F.lower(F.coalesce("context", F.lit(""))).alias("c"))
    t = t.select("id", F.size("terms").alias("total"), F.size(F.filter("terms", lambda w: F.contains(F.col("c"), w))).alias("matched"))
    return t.select("id", "matched", "total", ((F.col("total") > 0) & (F.col("matched") >= F.col("total") * share)).alias("hit"))


def leaks(ranked: DataFrame, groups: int, k: int = 5) -> DataFrame:
    """Per query over its first ``k`` rows (label, own_label): the share of its own label, and whether the next label, its hard negative, comes in, or comes first."""
    bad = F.col("label") == (F.col("own_label") + 1) % groups
    good = F.col("label") == F.col("own_label")
    g = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.avg(good.cast("double")).alias("purity"), F.max(bad.cast("int")).alias("leak"), F.min(F.when(good, F.col("rank"))).alias("g"), F.min(F.when(bad, F.col("rank"))).alias("b"))
    return g.select("query_id", F.round("purity", 6).alias("purity"), "leak", (F.col("g").isNotNull() & (F.col("b").isNull() | (F.col("g") < F.col("b")))).alias("preferred"))


def weighted_best(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, score): the greatest value, half of the second and a quarter of the third."""
    w = Window.partitionBy(group).orderBy(F.desc(value))
    top = rows.select(group, value, F.row_number().over(w).alias("k")).where("k <= 3")
    return top.groupBy(group).agg(F.round(F.sum(F.col(value) * F.when(F.col("k") == 1, 1.0).when(F.col("k") == 2, 0.5).otherwise(0.25)), 6).alias("score"))


def session_context(chunks: DataFrame, sessions: int = 4, most: int = 12) -> DataFrame:
    """(question, session_id, turn, place): the best sessions of each question in order of session, with their best chunks in order of turn.

    ``chunks``: question, session_id, turn, score. A session counts its three best chunks, weighted; each session gets at least two chunks.
    """
    w = Window.partitionBy("question", "session_id").orderBy(F.desc("score"), "turn")
    c = chunks.withColumn("k", F.row_number().over(w))
    weight = F.when(F.col("k") == 1, 1.0).when(F.col("k") == 2, 0.5).otherwise(0.25)
    s = c.where("k <= 3").groupBy("question", "session_id").agg(F.round(F.sum(F.col("score") * weight), 9).alias("total"))
    s = s.withColumn("nth", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("total"), "session_id"))).where(F.col("nth") <= sessions)
    n = s.groupBy("question").agg(F.greatest(F.lit(2), F.floor(F.lit(most) / F.count("*"))).alias("each"))
    kept = c.join(s.select("question", "session_id"), ["question", "session_id"]).join(n, "question").where(F.col("k") <= F.col("each"))
    return kept.select("question", "session_id", "turn", F.row_number().over(Window.partitionBy("question").orderBy("session_id", "turn")).alias("place"))


def middle_run(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median, stdev, n) over a group's runs, the upper middle one of an even number. A group has a few runs."""
    runs = F.sort_array(F.collect_list(value))
    g = rows.groupBy(group).agg(runs.alias("runs"), F.stddev_pop(value).alias("sd"))
    return g.select(group, F.round(F.get("runs", F.floor(F.size("runs") / 2).cast("int")), 6).alias("median"), F.round("sd", 6).alias("stdev"), F.size("runs").cast("long").alias("n"))
