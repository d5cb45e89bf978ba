"""Statistics over the scores of all queries with all vectors, without a row a pair.

Queries and vectors travel in blocks and meet in matrix products; a task returns counts, sums and histograms. The number of products is
quadratic by nature, but what is shuffled and held isn't: blocks of bounded size, and a few thousand numbers a label.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERIES, PARTS, BINS = 2048, 1024, 64, 4096
#: Medians are those of scores at this many digits.
DIGITS = 9
Save = Callable[[DataFrame], DataFrame]


def _packed(rows: DataFrame, keys: list[str], most: int, columns: list[str]) -> DataFrame:
    """``rows`` in blocks of one value of ``keys`` and of about ``most`` rows, with ``columns`` as arrays."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).alias("_parts"))  # a row a value
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).alias("r").join(sizes.alias("s"), same).select("r.*", "_parts")
    dealt = dealt.withColumn("_chunk", F.pmod(F.xxhash64("_row"), F.col("_parts")))
    return dealt.groupBy(*keys, "_chunk").agg(*(F.collect_list(c).alias(f"{c}s") for c in columns)).drop("_chunk")


def blocks(queries: DataFrame, vectors: DataFrame, save: Save) -> tuple[DataFrame, DataFrame]:
    """Blocks of ``queries`` (query_id, own, vec) and of ``vectors`` (id, label, vec). A label is a group; missing labels are one, missing ids are left out."""
    vec = F.coalesce(F.col("vec").cast("array<double>"), F.array().cast("array<double>"))
    q = queries.where("query_id is not null").select("query_id", "own", vec.alias("qvec")).withColumn("qdims", F.size("qvec"))
    v = vectors.where("id is not null").select("id", "label", vec.alias("vec")).withColumn("dims", F.size("vec"))
    q = _packed(q, ["own", "qdims"], QUERIES, ["query_id", "qvec"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    v = _packed(v, ["label", "dims"], BLOCK, ["id", "vec"]).withColumn("_part", F.pmod(F.xxhash64("label", F.get("ids", F.lit(0))), F.lit(PARTS)).cast("int"))
    return save(q), save(v)


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dims)


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    """Each pair of blocks (its other columns as a dict) with the scores of all its queries and vectors, those of a query with itself left out."""
    for b in batches:
        more = [n for n in b.schema.names if n not in ("query_ids", "qvecs", "ids", "vecs")]
        for i in range(b.num_rows):
            at = {n: b.column(n)[i].as_py() for n in more}
            qids, ids = (b.column(n)[i].values.to_numpy(zero_copy_only=False) for n in ("query_ids", "ids"))
            if at["dims"] == at["qdims"]:
                s = (_matrix(b.column("qvecs")[i].values, at["qdims"]) @ _matrix(b.column("vecs")[i].values, at["dims"]).T).ravel()
            else:
                s = np.zeros(len(qids) * len(ids))
            qi, vi = np.flatnonzero(np.isin(qids, ids)), np.flatnonzero(np.isin(ids, qids))
            x, y = np.nonzero(qids[qi][:, None] == ids[vi][None, :])
            yield at, np.delete(s, qi[x] * len(ids) + vi[y]) if len(x) else s


def _pairs(q: DataFrame, v: DataFrame) -> DataFrame:
    return v.join(q, "_part").drop("_part")


def _moments(pairs: DataFrame, digits: int | None) -> DataFrame:
    """(label, same, n, mean, m2, least, most) of each pair of blocks; ``m2``: the sum of squares around its mean."""
    kind = pairs.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, s in _scores(batches):
            if len(s):
                s = s if digits is None else np.round(s, digits)
                same = None if at["label"] is None or at["own"] is None else at["label"] == at["own"]
                mean = s.mean()
                row = {"label": at["label"], "same": same, "n": len(s), "mean": mean, "m2": ((s - mean) ** 2).sum(), "least": s.min(), "most": s.max()}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([(n, types[n]) for n in row]))

    names = pa.schema([("same", pa.bool_()), ("n", pa.int64()), *((n, pa.float64()) for n in ("mean", "m2", "least", "most"))])
    types = {f.name: f.type for f in names} | {"label": _arrow(kind)}
    return pairs.mapInArrow(run, f"label {kind}, same boolean, n long, mean double, m2 double, least double, most double")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string(), "boolean": pa.bool_()}[kind]


def _merged(parts: DataFrame, by: str) -> DataFrame:
    """(by, n, mean, sd, least, most) of the rows that ``parts`` sum up; a row a value of ``by``."""
    whole = parts.groupBy(by).agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("all"))
    each = parts.alias("p").join(whole.alias("w"), F.col(f"p.{by}").eqNullSafe(F.col(f"w.{by}"))).select("p.*", "all")
    spread = F.sqrt(F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("all"), F.lit(2))) / F.sum("n"))
    return each.groupBy(by).agg(F.sum("n").alias("n"), F.first("all").alias("mean"), spread.alias("sd"), F.min("least").alias("least"), F.max("most").alias("most"))


def _medians(q: DataFrame, v: DataFrame, found: DataFrame, save: Save) -> DataFrame:
    """(label, median): the mean of the two middle scores, by histograms of ``BINS`` bins that close in on them until a bin holds one value."""
    unit = 10**DIGITS
    key = lambda c: F.round(F.col(c) * unit).cast("long")
    at = found.select("label", key("least").alias("low"), F.greatest(F.lit(1), F.ceil((key("most") - key("least") + 1) / BINS)).cast("long").alias("width"), F.floor((F.col("n") - 1) / 2).alias("r0"), F.floor(F.col("n") / 2).alias("r1"))
    at = save(at.select("label", "width", F.col("low").alias("low0"), F.col("low").alias("low1"), "r0", "r1"))
    kind = at.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (label, t), h in held.items():
                some = np.flatnonzero(h)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(some), _arrow(kind)), pa.array([t] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(h[some], pa.int64())], ["label", "t", "bin", "n"])
            held.clear()

        for at, s in _scores(batches):
            keys = np.rint(s * unit).astype(np.int64)
            for t in (0, 1):
                b = (keys - at[f"low{t}"]) // at["width"]
                h = np.bincount(b[(b >= 0) & (b < BINS)], minlength=BINS)
                held[at["label"], t] = held[at["label"], t] + h if (at["label"], t) in held else h
            if len(held) > 2 * PARTS:
                yield from rows()
        yield from rows()

    while True:
        same = F.col("v.label").eqNullSafe(F.col("a.label"))
        placed = v.alias("v").join(at.alias("a"), same).select("v.*", "width", "low0", "low1")
        counts = _pairs(q, placed).mapInArrow(run, f"label {kind}, t int, bin int, n long").groupBy("label", "t", "bin").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy("label", "t").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        hit = counts.alias("c").join(at.alias("a"), F.col("c.label").eqNullSafe(F.col("a.label")))
        rank = F.when(F.col("t") == 0, F.col("r0")).otherwise(F.col("r1"))
        low = F.when(F.col("t") == 0, F.col("low0")).otherwise(F.col("low1")) + F.col("bin") * F.col("width")
        hit = hit.where((rank >= F.col("before")) & (rank < F.col("before") + F.col("c.n"))).select("a.label", "t", "width", low.alias("low"), (rank - F.col("before")).alias("r"))
        of = lambda c, t: F.max(F.when(F.col("t") == t, F.col(c))).alias(f"{c}{t}")
        new = hit.groupBy("label", "width").agg(of("low", 0), of("low", 1), of("r", 0), of("r", 1))
        at = save(new.withColumn("was", F.col("width")).withColumn("width", F.greatest(F.lit(1), F.ceil(F.col("width") / BINS)).cast("long")))
        if (at.agg(F.max("was")).first()[0] or 1) == 1:
            return at.select("label", ((F.col("low0") / unit + F.col("low1") / unit) / 2).alias("median"))
        at = at.drop("was")


def distribution(queries: DataFrame, vectors: DataFrame, save: Save) -> DataFrame:
    """(label, mean, median, stddev, least, most, n) of the scores of ``queries`` (query_id, vec) with the ``vectors`` (id, label, vec) of each label."""
    q, v = blocks(queries.withColumn("own", F.lit(None).cast("int")), vectors, save)
    found = save(_merged(save(_moments(_pairs(q, v), DIGITS)), "label"))
    r = lambda c, name: F.round(c, 6).alias(name)
    both = found.alias("f").join(_medians(q, v, found, save).alias("m"), F.col("f.label").eqNullSafe(F.col("m.label")))
    return both.select("f.label", r("mean", "mean"), r("median", "median"), r("sd", "stddev"), r("least", "least"), r("most", "most"), "n")


def gap(queries: DataFrame, vectors: DataFrame, save: Save) -> DataFrame:
    """Of the scores of ``queries`` (query_id, own, vec) with ``vectors`` (id, label, vec): mean, deviation and range for equal and other labels in one row, and the gap of the means."""
    q, v = blocks(queries, vectors, save)
    g = _merged(save(_moments(_pairs(q, v), None)), "same")
    part = lambda c, own: F.max(F.when(F.col("same") == F.lit(own), F.col(c)))
    r = lambda c, name: F.round(c, 6).alias(name)
    return g.agg(
        r(part("mean", True), "mean_same"), r(part("mean", False), "mean_other"), r(part("mean", True) - part("mean", False), "gap"), r(part("sd", True), "sd_same"), r(part("sd", False), "sd_other"),
        r(part("least", True), "least_same"), r(part("most", False), "most_other"),
    )
