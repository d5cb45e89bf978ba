"""Exact nearest vectors by dot product, in blocks, with groups left out that can't hold a better one.

Vectors are grouped around seeded centroids and packed into blocks of at most about ``BLOCK`` vectors of one group; a group that holds a third
of all vectors is many blocks. For a query q and a group with centroid c and radius r, no dot product exceeds q.c + |q| r
(Cauchy and Schwarz). Each query visits its groups in the order of that bound, a few more in each round, and is done when its next
bound is below its k-th best score. A block meets the queries that visit its group in matrix products.

With one group there is one round: every block meets every query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERIES = 2048, 256
#: Scores are compared at this many digits, so sums in another order give the same ranks.
DIGITS = 9
MOST_GROUPS = 4096


def _matrix(vectors, dims: int) -> np.ndarray:
    """Rows of doubles; what is missing or has another length is zero, so its products are."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dims:
            out[i] = v
    return out


def _rows(vectors: pa.Array, dims: int) -> np.ndarray:
    """The matrix of an Arrow array of lists of ``dims`` doubles each, without a copy."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centroids.T - 0.5 * (centroids**2).sum(1), axis=1)


def centroids(vectors: DataFrame, dims: int, groups: int, seed: int = 0, rounds: int = 2) -> np.ndarray:
    """At most ``groups`` centres: those vectors whose hashed ids are least, moved to the means of their groups ``rounds`` times."""
    if groups > MOST_GROUPS:
        raise ValueError(f"at most {MOST_GROUPS} groups")
    start = vectors.where(F.size("vec") == dims).orderBy(F.xxhash64("id", F.lit(seed)), "id").select("vec").limit(groups).toPandas()
    found = np.unique(_matrix(start.vec, dims), axis=0) if len(start) else np.zeros((1, dims))
    for _ in range(rounds if len(found) > 1 else 0):
        now = found

        def sums(batches: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            total, n = np.zeros_like(now), np.zeros(len(now))
            for b in batches:
                x = _matrix(b.vec, dims)
                own = _nearest(x, now)
                np.add.at(total, own, x)
                n += np.bincount(own, minlength=len(now))
            some = np.flatnonzero(n)
            if len(some):
                yield pd.DataFrame({"g": some, "n": n[some], "total": list(total[some])})

        each = vectors.select("vec").mapInPandas(sums, "g int, n double, total array<double>")
        added = each.select("g", "n", F.posexplode("total").alias("at", "x")).groupBy("g", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toPandas()  # groups x dims numbers
        found = now.copy()
        found[added.g.to_numpy(), added["at"].to_numpy()] = added.x / added.n
    return found


def blocks(vectors: DataFrame, centres: np.ndarray, block: int = BLOCK) -> DataFrame:
    """(g, chunk, n, radius, ids, vecs): the vectors (id, vec), group by group, in blocks; radius is that of the block."""
    dims = centres.shape[1]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b.vec, dims)
            own = _nearest(x, centres)
            yield b.assign(vec=list(x), g=own, away=np.linalg.norm(x - centres[own], axis=1))

    kind = vectors.schema["id"].dataType.simpleString()
    placed = vectors.select("id", "vec").mapInPandas(assign, f"id {kind}, vec array<double>, g int, away double")
    # A group's size decides into how many blocks its rows are dealt, by row and not by id, as ids may repeat.
    sizes = placed.groupBy("g").agg(F.count("*").alias("all"))  # a row a group
    dealt = placed.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(sizes), "g")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("row"), F.ceil(F.col("all") / block)).cast("int"))
    return dealt.groupBy("g", "chunk").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.collect_list("id").alias("ids"), F.collect_list("vec").alias("vecs"))


def topk(queries: DataFrame, vectors: DataFrame, k: int, save: Callable[[DataFrame], DataFrame], groups: int = 1, seed: int = 0, growth: int = 4) -> DataFrame:
    """(query_id, id, score, rank, compared): the ``k`` best of ``vectors`` (id, vec) for each of ``queries`` (query_id, vec), itself excluded.

    Of equal scores (at ``DIGITS`` digits) the smaller id is first. ``compared``: how many vectors the query was multiplied with. Null
    vectors, and vectors of another length than the first one's, score 0. ``save`` writes a table and reads it back. No vectors or queries: no rows.
    """
    first = vectors.where("size(vec) > 0").select(F.size("vec").alias("n")).first()
    dims = first.n if first else 1
    centres = centroids(vectors, dims, groups, seed) if groups > 1 else np.zeros((1, dims))
    held = save(blocks(vectors, centres))
    radii = {r.g: r.radius for r in held.groupBy("g").agg(F.max("radius").alias("radius")).collect()}  # a row a group
    known = np.array(sorted(radii), dtype=int)
    radius = np.array([radii[g] for g in known])
    id_kind = vectors.schema["id"].dataType.simpleString()
    best_kind = f"array<struct<low:double,id:{id_kind}>>"

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            q = _matrix(b.vec, dims)
            most = q @ centres[known].T + np.linalg.norm(q, axis=1)[:, None] * radius + 1e-9  # above what rounding can add
            order = np.argsort(-most, axis=1, kind="stable")
            yield pd.DataFrame({"query_id": b.query_id, "vec": list(q), "groups": list(known[order]), "bounds": list(np.take_along_axis(most, order, 1))})

    query_kind = queries.schema["query_id"].dataType.simpleString()
    state = queries.select("query_id", "vec").mapInPandas(bound, f"query_id {query_kind}, vec array<double>, groups array<int>, bounds array<double>")
    state = save(state.select("*", F.lit(0).alias("at"), F.from_json(F.lit("[]"), best_kind).alias("best"), F.lit(0).cast("long").alias("compared")))
    directory = held.select("g", "chunk", "n")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                # One block at a time, its numbers read where they lie; a whole batch as pandas objects takes several times its size.
                qids, qvecs, each, vecs = (batch.column(c)[i].values for c in ("qids", "qvecs", "ids", "vecs"))
                score = np.round(_rows(qvecs, dims) @ _rows(vecs, dims).T, DIGITS)
                asked, ids = (np.asarray(x.to_numpy(zero_copy_only=False)) for x in (qids, each))
                score[asked[:, None] == ids[None, :]] = -np.inf
                whose, which, low = [], [], []
                for q, s in enumerate(score):
                    least = np.partition(s, -k)[-k] if len(s) > k else -np.inf
                    near = np.flatnonzero((s >= least) & (s > -np.inf))
                    best = sorted(near, key=lambda j: (-s[j], ids[j]))[:k]  # noqa: B023
                    whose += [q] * len(best)
                    which += best
                    low += [-s[j] + 0.0 for j in best]
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(whose, pa.int64())), pa.array(low, pa.float64()), each.take(pa.array(which, pa.int64()))], ["query_id", "low", "id"])

    width, reach = 1, 0
    while reach < len(known):
        worst = F.when(F.size("best") >= k, -F.get("best", F.lit(k - 1))["low"])
        rest = F.arrays_zip(F.slice("groups", F.col("at") + 1, F.lit(width)).alias("g"), F.slice("bounds", F.col("at") + 1, F.lit(width)).alias("most"))
        visit = state.select("query_id", "vec", worst.alias("worst"), F.explode(rest).alias("x")).where("worst is null or x.most >= worst").select("query_id", "vec", "x.g")
        visit = save(visit)
        if visit.isEmpty():
            break
        # The queries of a group in rows of at most about QUERIES, each sent to every block of the group.
        counted = visit.groupBy("g").agg(F.ceil(F.count("*") / QUERIES).alias("parts"))  # a row a group
        packed = visit.join(F.broadcast(counted), "g").withColumn("part", F.pmod(F.xxhash64("query_id", F.monotonically_increasing_id()), F.col("parts")))
        packed = packed.groupBy("g", "part").agg(F.collect_list("query_id").alias("qids"), F.collect_list("vec").alias("qvecs"))
        sent = packed.join(directory, "g").drop("part", "n")
        pairs = sent.join(held.select("g", "chunk", "ids", "vecs"), ["g", "chunk"]).select("qids", "qvecs", "ids", "vecs")
        found = pairs.mapInArrow(multiply, f"query_id {query_kind}, low double, id {id_kind}")
        among = Window.partitionBy("query_id").orderBy("low", "id")
        found = found.withColumn("place", F.row_number().over(among)).where(F.col("place") <= k).groupBy("query_id").agg(F.collect_list(F.struct("low", "id")).alias("more"))
        seen = visit.join(directory.groupBy("g").agg(F.sum("n").alias("n")), "g").groupBy("query_id").agg(F.sum("n").alias("n"))
        next_state = state.join(found, "query_id", "left").join(seen, "query_id", "left")
        both = F.slice(F.sort_array(F.concat("best", F.coalesce("more", F.from_json(F.lit("[]"), best_kind)))), 1, k)
        state = save(next_state.select("query_id", "vec", "groups", "bounds", (F.col("at") + width).alias("at"), both.alias("best"), (F.col("compared") + F.coalesce("n", F.lit(0))).alias("compared")))
        reach += width
        width *= growth
    out = state.select("query_id", "compared", F.posexplode("best").alias("place", "b"))
    return out.select("query_id", "b.id", (-F.col("b.low") + 0.0).alias("score"), (F.col("place") + 1).alias("rank"), "compared")


def meet(queries: DataFrame, vectors: DataFrame, least: float, how: Callable[[list, np.ndarray, np.ndarray], pd.DataFrame], schema: str, save: Callable[[DataFrame], DataFrame], groups: int = 1, seed: int = 0) -> DataFrame:
    """Rows that ``how(query_ids, ids, near)`` makes of each block of ``queries`` (query_id, vec) with each block of ``vectors`` (id, vec) that may be near.

    ``near`` is a matrix: whether a dot product is above ``least``. Blocks whose bound isn't above it don't meet. Ids needn't be unique.
    """
    first = vectors.where("size(vec) > 0").select(F.size("vec").alias("n")).first()
    dims = first.n if first else 1
    centres = centroids(vectors, dims, groups, seed) if groups > 1 else np.zeros((1, dims))
    held = save(blocks(vectors, centres))
    radii = {r.g: r.radius for r in held.groupBy("g").agg(F.max("radius").alias("radius")).collect()}  # a row a group
    radius = np.array([radii.get(g, -np.inf) for g in range(len(centres))])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            q = _matrix(b.vec, dims)
            yield pd.DataFrame({"query_id": b.query_id, "qvec": list(q), "size": np.linalg.norm(q, axis=1), "home": _nearest(q, centres)})

    # Queries travel in blocks too, as many as they need, each with one centre and radius of its own.
    kind = queries.schema["query_id"].dataType.simpleString()
    placed = queries.select("query_id", "vec").mapInPandas(assign, f"query_id {kind}, qvec array<double>, size double, home int")
    placed = placed.withColumn("part", F.floor(F.monotonically_increasing_id() / QUERIES))
    packed = placed.groupBy("home", "part").agg(F.collect_list("query_id").alias("qids"), F.collect_list("qvec").alias("qvecs"))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                q = _matrix(row.qvecs, dims)
                # The least radius at which a group can hold a vector that is near one of these queries.
                need = ((least - q @ centres.T) / np.maximum(np.linalg.norm(q, axis=1), 1e-300)[:, None]).min(axis=0) - 1e-9
                some = [int(g) for g in np.flatnonzero(radius >= need)]
                qids, qvecs = list(row.qids), q.ravel().tolist()
                if some:
                    yield pd.DataFrame({"qids": [qids] * len(some), "qvecs": [qvecs] * len(some), "g": some, "need": need[some]})

    sent = packed.mapInPandas(visits, f"qids array<{kind}>, qvecs array<double>, g int, need double")
    pairs = sent.join(held, "g").where("radius >= need").select("qids", "qvecs", "ids", "vecs")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                near = np.round(np.asarray(row.qvecs).reshape(-1, dims) @ _matrix(row.vecs, dims).T, DIGITS) > least
                if near.any():
                    yield how(list(row.qids), np.asarray(row.ids), near)

    return pairs.mapInPandas(run, schema)
