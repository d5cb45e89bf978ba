"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text are the shapes of its byte trigrams (each byte reduced to one of 12 classes: lower, upper, digit, space, line
end, and kinds of punctuation) and a few terms for how repetitive its words and lines are. ``fit`` takes at most
``max_labelled`` labelled texts (those with the least hashed doc_id), weights their terms by tf-idf, and keeps the leading
singular directions. Their vectors and labels are broadcast (``max_labelled`` x ``dims`` floats at most). ``score`` maps every
document into the same space and takes exact cosines with all labelled vectors, block by block; the ``neighbours`` most
similar vote, weighted by a power of their similarity.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, text_of

CLASSES = 12
_CLASS = np.zeros(256, np.int32)  # 0: lower case and bytes of other letters
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", ".", ",", "!?", "|", "-'\"()", "\t\v\f", ";:"), 1):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _k
for _b in range(33, 127):
    if not chr(_b).isalnum() and not _CLASS[_b]:
        _CLASS[_b] = 7  # other signs count with ! and ?
SHAPES = CLASSES**3
STEPS = 12
TERMS = SHAPES + 16 + 16 * STEPS + 3 * STEPS
#: Labelled rows that are dense at once while the space is fitted.
BLOCK = 512


def _step(share: float) -> int:
    return min(STEPS - 1, int(share * STEPS))


def terms(text: str) -> np.ndarray:
    """Term weights of one whole text."""
    raw = text.encode()
    out = np.zeros(TERMS, np.float32)
    c = _CLASS[np.frombuffer(raw, np.uint8)]
    if len(c) > 2:
        n = np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=SHAPES)
        out[:SHAPES] = np.sqrt(n / (len(c) - 2))
    words = raw.split()
    n, count = max(1, len(words)), Counter(words)
    size = min(15, len(words).bit_length())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    at = SHAPES
    out[at + size] = 0.2
    out[at + 16 + size * STEPS + _step(len(count) / n)] = 0.5
    at += 16 + 16 * STEPS
    out[at + _step(max(count.values(), default=0) / n)] = 0.3
    out[at + STEPS + _step(pairs / max(1, n - 1))] = 0.5
    out[at + 2 * STEPS + _step(len(set(lines)) / max(1, len(lines)))] = 0.5
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 8192, dims: int = 64) -> dict:
    """The space and the labelled vectors, from at most ``max_labelled`` rows of ``labels`` (doc_id, quality).

    Labels without an id, a value or a document don't count; without any, all scores are 0.5.
    """
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id", "quality").limit(max_labelled)
    # A repeated doc_id brings its least text only, so no more rows come than labels.
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sparse = [(np.flatnonzero(v), v) for v in map(terms, b.text)]
            yield pd.DataFrame({"doc_id": b.doc_id, "quality": b.quality, "at": [i for i, _ in sparse], "w": [v[i] for i, v in sparse]})

    got = rows.mapInPandas(count, "doc_id long, quality int, at array<int>, w array<float>").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("quality", "ascending")]).combine_chunks()
    n = got.num_rows
    # Rows stay sparse and are filled in block by block; a quarter of a gigabyte less on the driver than dense ones and doubles.
    at, w = got.column("at"), got.column("w")
    ends = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (at, w)]
    offsets, where, weight = ends[0].offsets.to_numpy(), ends[0].values.to_numpy().astype(np.int16), ends[1].values.to_numpy()
    labels = got.column("quality").to_numpy().astype(np.float32)
    del got, at, w, ends

    def block(k: int) -> np.ndarray:
        part = offsets[k : k + BLOCK + 1]
        out = np.zeros((len(part) - 1, TERMS), np.float32)
        out[np.repeat(np.arange(len(part) - 1), np.diff(part)), where[part[0] : part[-1]]] = weight[part[0] : part[-1]]
        return out

    idf = (1 + np.log((1 + n) / (1 + np.bincount(where[weight != 0], minlength=TERMS)))).astype(np.float32)
    gram = np.zeros((TERMS, TERMS), np.float32)
    for k in range(0, n, BLOCK):
        part = block(k) * idf
        gram += part.T @ part
    directions = np.linalg.eigh(gram)[1][:, ::-1][:, :dims]
    axes = np.ascontiguousarray(directions) * idf[:, None]
    del gram, directions
    known = np.concatenate([np.zeros((0, axes.shape[1]), np.float32), *(_unit(block(k) @ axes) for k in range(0, n, BLOCK))])
    return {"axes": axes, "known": known, "labels": labels}


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def vote(model: dict, x: np.ndarray, neighbours: int, power: float) -> np.ndarray:
    """Scores of term rows: exact cosines with every labelled vector, similarity-weighted labels of the nearest."""
    if not len(model["labels"]):
        return np.full(len(x), 0.5)
    cos = _unit(x @ model["axes"]) @ model["known"].T
    k = min(neighbours, cos.shape[1])
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cos, near, 1), 1e-3).astype(np.float64) ** power
    # Rounded, as the same text may meet another order of sums in another block.
    return np.round(np.clip((weight * model["labels"][near]).sum(1) / weight.sum(1), 0, 1), 9)


def score(docs: DataFrame, model: dict, neighbours: int = 15, power: float = 16.0, block: int = 256) -> DataFrame:
    """doc_id and score of every row.

    Null and empty texts are scored as empty; a null doc_id stays; other columns are ignored; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), block):
                part = b.iloc[k : k + block]
                yield pd.DataFrame({"doc_id": part.doc_id, "score": vote(shared.value, np.stack([terms(t) for t in part.text]), neighbours, power)})

    return docs.select("doc_id", text_of().alias("text")).mapInPandas(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: dict, least: float, neighbours: int = 15, power: float = 16.0, block: int = 256) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with all their columns, whatever these are called.

    Null texts are scored as empty ones and stay null; a null doc_id stays; repeated rows are judged alike; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, block):
                part = batch.slice(a, block)
                x = np.stack([terms(t.as_py() or "") for t in part.column(at)])
                yield part.filter(pa.array(vote(shared.value, x, neighbours, power) >= least))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> F.Column:
    """Documents whose crc32(doc_id as text) mod 5 is 0; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
