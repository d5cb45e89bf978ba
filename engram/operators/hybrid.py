"""Hybrid retrieval: two dense indexes and a lexical one, fused by rank, with raw scores for hits of one list only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import index
from .retrieval import dot

#: What a scope match adds to a fused score, and the constant of rank fusion.
SCOPE_BOOST, RRF_K = 0.05, 60


def lexical_scores(docs: DataFrame, queries: DataFrame, prefixes: bool = True) -> DataFrame:
    """(request_id, id, score) of BM25 over summary and details of ``docs`` (id, summary, details) for ``queries`` (request_id, query), without an index.

    Any query term may match, as a whole term or, with ``prefixes``, as the beginning of one. All statistics are those of ``docs``, so the
    whole table is tokenised; ``index.search`` reads a stored index instead.
    """
    by_id = index.tokens(docs)
    postings = by_id.where("term is not null")
    dictionary = postings.groupBy("term", "f").agg(F.count("*").alias("df"))
    stats = by_id.where("term is null").groupBy("f").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
    return index.scores(index.matching(dictionary, index.wanted_terms(queries), prefixes), postings, stats)


def dense_scores(queries: DataFrame, vectors: DataFrame, blocks: int = 8) -> DataFrame:
    """(request_id, id, score): the cosine of each of ``queries`` (request_id, vec) with each of ``vectors`` (id, vec).

    Queries are gathered into ``blocks`` rows, so each vector is read once a block. They are a stated, small set: the caller's requests.
    """
    held = queries.groupBy(F.pmod(F.xxhash64("request_id"), F.lit(blocks)).alias("b")).agg(F.collect_list(F.struct("request_id", "vec")).alias("qs"))
    each = F.transform("qs", lambda q: F.struct(q["request_id"].alias("request_id"), F.round(dot(q["vec"], F.col("vec")), 9).alias("score")))
    return vectors.crossJoin(F.broadcast(held)).select("id", F.explode(each).alias("s")).select("s.request_id", "id", "s.score")  # at most ``blocks`` rows


def _ranked(rows: DataFrame, score: str, most: int) -> DataFrame:
    w = Window.partitionBy("request_id").orderBy(F.desc(score), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def retrieve(candidates: DataFrame, limits: DataFrame, full: DataFrame, brief: DataFrame, lexical: DataFrame, at_most: int) -> DataFrame:
    """(request_id, id, score, source, rank): the best candidates of each request.

    ``candidates``: request_id, id, in_scope; ``limits``: request_id, most (rows wanted, none above ``at_most``); ``full``, ``brief``,
    ``lexical``: request_id, id, score. A plain number bounds each list first, so every task keeps its best rows before they are sent
    and no request's rows meet in one task; then the request's own limit holds. Each list has twice the limit at most. A row in both lists keeps its fused score (``hybrid``), one in a single list its raw
    score (``vector`` or ``lexical``); rows in scope get a boost. If only one list has rows, it is taken as it is.
    """
    counted = candidates.groupBy("request_id").agg(F.count("*").alias("n")).join(limits, "request_id").select("request_id", "most", F.least(F.col("n"), F.col("most") * 2).alias("wider"))
    own = lambda rows: _ranked(rows.join(candidates, ["request_id", "id"]), "score", 2 * at_most).join(counted, "request_id").where("rank <= wider")
    both = own(full).unionByName(own(brief))
    dense = both.groupBy("request_id", "id", "in_scope", "most", "wider").agg(F.max("score").alias("score"))
    dense = _ranked(dense, "score", 2 * at_most).where("rank <= wider").withColumn("source", F.lit("vector"))
    lists = dense.unionByName(own(lexical).withColumn("source", F.lit("lexical")))
    fused = lists.groupBy("request_id", "id", "in_scope", "most").agg(
        F.round(F.sum(F.lit(1.0) / (F.col("rank") + RRF_K)), 12).alias("rrf"), F.max("score").alias("raw"), F.min("rank").alias("own_rank"), F.count("*").alias("lists"), F.min("source").alias("one")
    )
    kinds = lists.groupBy("request_id").agg(F.count_distinct("source").alias("kinds"))
    fused = fused.join(kinds, "request_id")
    alone = F.col("kinds") == 1
    first = Window.partitionBy("request_id").orderBy(F.when(alone, F.col("own_rank")).otherwise(F.lit(0)), F.desc("rrf"), "id")
    kept = fused.withColumn("place", F.row_number().over(first)).where(F.col("place") <= F.col("most"))
    score = F.when(F.col("lists") == 2, F.col("rrf")).otherwise(F.col("raw")) + F.when(~alone & F.col("in_scope"), SCOPE_BOOST).otherwise(0.0)
    kept = kept.withColumn("score", F.round(score, 9)).withColumn("source", F.when(F.col("lists") == 2, "hybrid").otherwise(F.col("one")))
    last = Window.partitionBy("request_id").orderBy(F.desc("score"), "id")
    return kept.withColumn("rank", F.row_number().over(last)).select("request_id", "id", "score", "source", "rank")
