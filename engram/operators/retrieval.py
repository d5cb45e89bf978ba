"""Lexical and dense retrieval, rank fusion and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapters import checkpointed
from . import nearest


def dot(a: Column, b: Column) -> Column:
    """Dot product in element order; 0 if lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(0.0)


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, groups: int = 1) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best of ``vectors`` (id, vec) for each of ``queries`` (query_id, vec), self excluded.

    In blocks of matrix products; with several ``groups`` those that can't hold a better vector are left out (``nearest``).
    """
    return nearest.topk(queries, vectors, k, checkpointed, groups).select("query_id", "id", "score", "rank")


def best(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows (query_id, id, score) of each query, with their rank."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, id, rank): query_id, id, score, sources, rank."""
    union = lists[0].select("query_id", "id", "rank")
    for x in lists[1:]:
        union = union.unionByName(x.select("query_id", "id", "rank"))
    fused = union.groupBy("query_id", "id").agg(F.sum(F.lit(1.0) / (F.col("rank") + k)).alias("score"), F.count("*").alias("sources"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")))


def ir_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """Per query: precision, recall, reciprocal rank and NDCG at ``k``; recall is 1 and NDCG 0 without relevant rows."""
    hits = ranked.where(F.col("rank") <= k).join(relevant.withColumn("hit", F.lit(1)), ["query_id", "id"], "left").groupBy("query_id").agg(
        F.sum(F.coalesce("hit", F.lit(0))).alias("hits"),
        F.max(F.when(F.col("hit") == 1, F.lit(1.0) / F.col("rank")).otherwise(0.0)).alias("rr"),
        F.sum(F.when(F.col("hit") == 1, F.lit(1.0) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    all_of = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1))
    return hits.join(all_of, "query_id", "left").select(
        "query_id",
        (F.col("hits") / k).alias("precision"),
        F.when(F.col("n").isNull(), 1.0).otherwise(F.col("hits") / F.col("n")).alias("recall"),
        "rr",
        F.when(F.col("n").isNull(), 0.0).otherwise(F.col("dcg") / ideal).alias("ndcg"),
    )
