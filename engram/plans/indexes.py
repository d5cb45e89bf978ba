"""Queries of the stored index and of versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index, retrieval
from ..sources import adapters as src
from ..sources.store import Store
from .queries import LEX, M, all_memories, query

DICTIONARY = "tf as (select id, f, len(t) as n, term, count(*) as tf from (select id, f, t, unnest(t) as term from tok) group by all), df as (select f, term, count(*) as df from tf group by all)"
#: Memories whose number leaves 3 by 10 get another text; those whose number leaves 7 go.
CHANGED = "memories0 as (select id, seq, summary, details from memories where seq % 10 not in (3, 7) union all select id, seq, 'Renamed ' || lang, 'fresh words about topic' || (seq % 4) || ' ' || summary from memories where seq % 10 = 3)"

#: The texts of benchmark that are queries of an updated index.
SOME = "item_id % 20 = 0"


def lexical_sql(rows: str) -> str:
    return LEX.replace("from memories", f"from {rows}")


def top_sql(rows: str, first: str) -> str:
    """The ten best memories of each query by BM25 with prefixes, over the relation ``rows``."""
    return f"""{first}, {lexical_sql(rows)}, mean as (select f, greatest(avg(len(t)), 1e-9) as m, count(*) as docs from tok group by f), {DICTIONARY},
s as (select query_id, id, round(sum(ln(1e0 + (docs - df + 5e-1) / (df + 5e-1)) * tf * 22e-1 / (tf + 12e-1 * (25e-2 + n * 75e-2 / m)) * case df.f when 's' then 25e-1 else 1e0 end * case when qtok.term = df.term then 1e0 else 375e-3 end), 6) as score
 from qtok join df on starts_with(df.term, qtok.term) join tf on tf.f = df.f and tf.term = df.term join mean on mean.f = df.f group by all)
select query_id, id, round(score, 4) as score, row_number() over (partition by query_id order by score desc, id)::int as rank from s qualify rank <= 10"""


def _queries(spark, sf, which: str = "true") -> DataFrame:
    return src.read(spark, sf, "benchmark").where(which).select(F.col("item_id").alias("request_id"), F.col("text").alias("query"))


def _top(held: Store, queries: DataFrame) -> DataFrame:
    found = index.best(held, queries, 10, save=src.stored)
    return retrieval.best(found.withColumnRenamed("request_id", "query_id"), 10).withColumn("score", F.round("score", 4))


@query(f"with {M}, {LEX}, {DICTIONARY} select df.f, df.term, df, sum(tf)::bigint as tf, sum(n)::bigint as lengths from tf join df using (f, term) group by df.f, df.term, df")
def index_build(spark, sf):
    """The dictionary of the stored index, held against its postings."""
    s = all_memories(spark, sf)
    held = s.read(index.POSTINGS).groupBy("f", "term").agg(F.sum("tf").alias("tf"), F.sum("n").cast("long").alias("lengths"))
    return s.read(index.TERMS).join(held, ["f", "term"], "full").select("f", "term", "df", "tf", "lengths")


@query(f"with {M}, {top_sql('memories', '').lstrip(', ').replace(f' where {SOME}', '')}")
def index_search(spark, sf):
    """Words and beginnings of words of all texts of benchmark, looked up in the stored index."""
    return _top(all_memories(spark, sf), _queries(spark, sf))


@query(f"with {M}, {top_sql('memories0', CHANGED)}")
def index_update(spark, sf):
    """The search after a tenth of the memories has changed and another tenth is gone: an index of its own, updated by bucket."""
    m = src.memories(spark, sf)
    held = src.store(spark, "index-update")
    index.build(held, m.select("id", "summary", "details"))
    fresh = m.where("seq % 10 = 3").select("id", F.concat(F.lit("Renamed "), "lang").alias("summary"), F.concat(F.lit("fresh words about topic"), F.col("seq") % 4, F.lit(" "), "summary").alias("details"))
    index.update(held, fresh, m.where("seq % 10 = 7").select("id"))
    return _top(held, _queries(spark, sf, SOME))
