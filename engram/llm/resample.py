"""Importance resampling towards a target distribution, with n-grams from a table of word positions.

``grams`` explodes each document's words with their places; for orders above one, lead() within the document joins the words that
follow. Each gram falls in a bucket by its hash. Buckets of the corpus and of the target are counted (a row a bucket); a bucket's gain
is the logarithm of how much more often the target has it. Gains are joined to the grams again and their mean is a document's
weight. Documents are then drawn without replacement by Gumbel noise: the largest sums of weight and noise are the sample.

Ranks need no global sort in one task: scores are whole numbers in a narrow range (gains and noise are both bounded by logarithms of
counts), so a count for each score tells the last score that is drawn and how many rows stand before each; rows of the
same score are numbered among themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read, text_of

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Gains are collected to compute them alike everywhere and broadcast, a row a bucket.
MOST_BUCKETS = 1 << 20


def grams(docs: DataFrame, orders: tuple[int, int], buckets: int, *keys: str) -> DataFrame:
    """(*keys, n_words, bucket): a row for each run of ``orders[0]`` to ``orders[1]`` words of ``docs`` (keys, text); the keys name a row.

    Documents without a run keep one row with a null bucket.
    """
    first, last = orders
    if not 1 <= first <= last:
        raise ValueError("orders are a least and a greatest length of one or more")
    cut = F.array_remove(F.split(F.translate(text_of(), UPPER, LOWER), BREAKS), "")
    words = docs.select(*keys, cut.alias("ws")).select(*keys, F.size("ws").alias("n_words"), F.posexplode_outer("ws").alias("at", "word"))
    hashed = lambda gram: F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets)).cast("int")
    if last == 1:  # nothing follows, so no window
        return words.select(*keys, "n_words", hashed(F.col("word")).alias("bucket"))
    follow = Window.partitionBy(*keys).orderBy("at")
    words = words.select(*keys, "n_words", F.array("word", *(F.lead("word", k).over(follow) for k in range(1, last))).alias("run"))
    joined = lambda n: F.when(F.get("run", F.lit(n - 1)).isNotNull(), hashed(F.array_join(F.slice("run", 1, n), " ")))
    # The last words of a document begin no run of some lengths; a document without any run keeps its row.
    some = F.array_compact(F.array(*(joined(n) for n in range(first, last + 1))))
    return words.select(*keys, "n_words", F.explode_outer(some).alias("bucket"))


def gains(corpus: DataFrame, target: DataFrame, orders: tuple[int, int], buckets: int, scale: int) -> DataFrame:
    """(bucket, gain) of the buckets that ``corpus`` (text) has; at most ``buckets`` rows come to the driver."""
    if buckets > MOST_BUCKETS:
        raise ValueError(f"at most {MOST_BUCKETS} buckets")

    def count(df: DataFrame) -> dict[int, int]:
        found = grams(df.select(F.monotonically_increasing_id().alias("row"), "text"), orders, buckets, "row").where("bucket is not null")
        return {r.bucket: r.n for r in found.groupBy("bucket").agg(F.count("*").alias("n")).collect()}

    s, t = count(corpus), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(scale * math.log(float(t.get(b, 0) + 1) * float(all_s + buckets) / (float(s[b] + 1) * float(all_t + buckets))))
    return corpus.sparkSession.createDataFrame([(b, gain(b)) for b in s], "bucket int, gain long")


def weighed(docs: DataFrame, gain: DataFrame, orders: tuple[int, int], buckets: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of ``docs``: the mean gain of its grams, rounded down; without grams 0."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    # All grams of a row are in one task, which sums them before anything is shuffled.
    found = grams(rows, orders, buckets, "row", "doc_id").join(F.broadcast(gain), "bucket", "left")
    found = found.groupBy("row", "doc_id").agg(F.max("n_words").cast("long").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    mean = F.when(F.col("n_features") == 0, 0).otherwise(F.expr("(total - pmod(total, n_features)) div n_features")).cast("long")
    return found.select("doc_id", "n_words", "n_features", mean.alias("weight"))


def noise(seed: int, scale: int) -> Column:
    """Gumbel noise of a doc_id, as a whole number; a null doc_id counts as the empty text."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-float(scale) * F.log(-F.log(u))).cast("long")


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``scored``, a table, with the rank of the rows drawn: the ``percent`` highest scores of the rows with enough words."""
    able = scored.where(F.col("n_words") >= least_words)
    by_score = able.groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect()  # as many as there are scores, see above
    draw, before = sum(r.n for r in by_score) * percent // 100, []
    seen = 0
    for r in by_score:
        if seen >= draw:
            break
        before.append((r.score, seen))
        seen += r.n
    edge = before[-1][0] if before else None
    drawn = F.lit(False) if edge is None else (F.col("n_words") >= least_words) & (F.col("score") >= edge)
    ahead = scored.sparkSession.createDataFrame(before, "score long, ahead long")
    among = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")
    place = (F.col("ahead") + F.row_number().over(among)).cast("long")
    some = scored.where(drawn).join(F.broadcast(ahead), "score").withColumn("place", place)
    some = some.withColumn("rank", F.when(F.col("place") <= draw, F.col("place")))
    return some.drop("ahead", "place").unionByName(scored.where(~drawn).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, orders: tuple[int, int] = (1, 2), buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 0, scale: int = 1000
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null where not drawn) of every row of ``docs`` (doc_id, text), like ``target`` (text).

    Null and empty texts have no grams, weigh 0 and are never drawn, as they have fewer than ``least_words`` words (1 or more). A null
    doc_id has the noise of the empty text and comes after other ids of its score; rows of one doc_id have the same noise, and
    equal rows follow each other. Other columns are ignored; no rows give no rows; without a target all buckets are alike rare in it.
    """
    gain = gains(docs.select("text"), target.select("text"), orders, buckets, scale)
    rows = weighed(docs, gain, orders, buckets)
    scored = materialize(rows.select("*", (F.col("weight") + noise(seed, scale)).alias("score")), "resample-scores")
    return ranked(scored, percent, max(1, least_words)).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def op12_resampling(spark, sf_dir: str) -> DataFrame:
    out = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), orders=(1, 1), seed=2024)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: The same rows by DuckDB, which has no crc32: its table of 256 values is computed, and each distinct word hashed once.
OP12_SQL = r"""
with recursive step as (
    select i::ubigint as i, i::ubigint as v, 0 as k from range(256) t(i)
    union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384::ubigint) else v >> 1 end, k + 1 from step where k < 8
), crc as (select list(v order by i) as t from step where k = 8),
cut as (
    select 'd' as side, doc_id, row_number() over () as rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from documents
    union all select 't', null, -row_number() over (), list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') from benchmark
), word as (select side, rid, unnest(ws) as w from cut),
byte as (select w, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), (2 * i - 1)::int, 2))::ubigint) as bs from (select distinct w from word)),
hashed as (select w, xor(list_reduce(list_prepend(4294967295::ubigint, bs), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::bigint + 1])), 4294967295::ubigint) % 10000 as bucket from byte, crc),
gram as (select side, rid, bucket from word join hashed using (w)),
total as (select count(*) filter (side = 'd') as s_all, count(*) filter (side = 't') as t_all from gram),
gain as (
    select bucket, floor(1000 * ln((count(*) filter (side = 't') + 1)::double * (any_value(s_all) + 10000)::double / ((count(*) filter (side = 'd') + 1)::double * (any_value(t_all) + 10000)::double)))::bigint as gain
    from gram, total group by bucket
), summed as (select rid, count(*) as n, sum(gain)::bigint as total from gram join gain using (bucket) where side = 'd' group by rid),
scored as (
    select doc_id, coalesce(n, 0) as n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::bigint as weight,
        floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 5e-1) / 4294967296e0)))::bigint as noise
    from cut left join summed using (rid) where side = 'd'
), able as (select doc_id, row_number() over (order by weight + noise desc, doc_id) as place, count(*) over () as n from scored where n_features >= 20)
select doc_id, n_features, weight, weight + noise as score, case when place <= n * 10 // 100 then place end as rank from scored left join able using (doc_id)
"""
