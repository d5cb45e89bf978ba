"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most 3 bits have a common neighbour: one is at most 1 bit away from it, the other
at most 2. Every fingerprint therefore emits variants around itself; what meets at a variant is a link. Work is linear in
the variants, because a meeting place with at least one member within 1 bit links all its members (1 + 2 <= 3), so each
is tied to one of them and no pairs of a group are listed. A place with members at 2 bits only links nothing.

Of the 2-bit variants only those with both bits in one 32-bit half are needed: of 3 differing bits, two share a half.

Most fingerprints have no neighbour at all, so a cheaper ball comes first. Of at most 3 differing bits, one half has at most
1: each half emits its 33 variants within half the radius (3 // 2 = 1), and only fingerprints that meet another's half there
go on to the full ball. Documents with equal fingerprints count once throughout and share the component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, read, text_of
from .components import components

RADIUS = 3


def shingles(text: str, words: int = 3, seed: int = 42) -> np.ndarray:
    """The XXH64 of all word shingles of the A-Z-lower-cased text, in order; none without words."""
    import xxhash

    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(parts))
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles of the A-Z-lower-cased text; 0 without words."""
    return majority(shingles(text, words, seed))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of ``hashes`` have; 0 for none."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 8192):
        ones += np.unpackbits(hashes[k : k + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (signed long) of every row; null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words, seed) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, fp long")


def _bit(k: int) -> int:
    return 1 << k if k < 63 else -(1 << 63)


def _flips(masks: list[int]) -> Column:
    return F.from_json(F.lit("[" + ",".join(map(str, masks)) + "]"), "array<bigint>")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (column fp) exactly as all links within 3 bits would."""
    half = lambda h: F.shiftrightunsigned("fp", 32 * h).bitwiseAND(F.lit(0xFFFFFFFF))
    sides = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(h).alias("side"), half(h).alias("part")) for h in (0, 1)))).alias("s")).select("fp", "s.side", "s.part")
    ball = F.transform(_flips([0] + [1 << k for k in range(32)]), lambda m: F.struct(F.col("part").bitwiseXOR(m).alias("at"), (m == 0).alias("centre")))
    seen = sides.select("side", F.explode(ball).alias("v")).select("side", "v.at", "v.centre")
    # A centre that meets another: at its own place somebody else is, too.
    busy = materialize(
        seen.groupBy("side", "at").agg(F.count("*").alias("n"), F.count(F.when(F.col("centre"), 1)).alias("centres")).where("n > 1 and centres > 0").select("side", "at"),
        "simhash-busy",
    )
    near = sides.select("fp", "side", F.explode(F.transform(ball, lambda v: v["at"])).alias("at")).join(busy, ["side", "at"], "left_semi").select("fp", "side").distinct()
    near = materialize(near, "simhash-near")
    # Variants of the full fingerprint: within 1 bit always, and 2 bits in the half other than the one that met.
    small = [0] + [_bit(k) for k in range(64)]
    pairs = lambda h: [_bit(i) ^ _bit(j) for i in range(32 * h, 32 * h + 32) for j in range(i + 1, 32 * h + 32)]
    at = lambda masks, close: F.transform(_flips(masks), lambda m: F.struct(F.col("fp").bitwiseXOR(m).alias("at"), F.lit(close).alias("close")))
    balls = (
        near.select("fp").distinct().select("fp", F.explode(at(small, True)).alias("v")),
        near.where("side = 1").select("fp", F.explode(at(pairs(0), False)).alias("v")),
        near.where("side = 0").select("fp", F.explode(at(pairs(1), False)).alias("v")),
    )
    met = balls[0].unionByName(balls[1]).unionByName(balls[2]).select("fp", "v.at", "v.close")
    # Only places where at least two meet, one of them close, are of use; hubs are the least close fingerprints.
    hubs = materialize(met.groupBy("at").agg(F.count("*").alias("n"), F.min(F.when(F.col("close"), F.col("fp"))).alias("hub")).where("n > 1 and hub is not null").select("at", "hub"), "simhash-hubs")
    # Sizes are estimated before explode, so without the hint the variants could be broadcast.
    return met.join(hubs.hint("merge"), "at").where("fp != hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text).

    Rows are linked if their fingerprints differ in at most 3 bits; component_id is the least doc_id reachable (null only
    if no member has an id). Null, empty and wordless texts have fingerprint zero and are linked like others; fewer words
    than a shingle make one shingle. Repeated rows stay; other columns are ignored; no rows give no rows.
    """
    marked = materialize(fingerprints(docs, words, seed), "simhash-docs")
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-fps")
    roots = components(links(fps))
    placed = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed, "simhash-placed")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(placed.join(materialize(least, "simhash-least"), "root").select("fp", "component_id"), "simhash-named")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
