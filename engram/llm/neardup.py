"""Near-duplicate documents: ball hashing and MinHash bands find pairs, the Jaccard similarity of the word shingles decides each.

The shingle set of a text is the XXH64 of all runs of ``WORDS`` words of the A-Z-lower-cased text (one shingle where there are
fewer words). The SimHash of a text's shingles, repeats included, goes through ball hashing (``simhash.links``): texts whose fingerprints
differ in at most 3 bits come into one bucket, that of the fingerprint that they are tied to. Copies at a similarity near 0.8 differ in more
bits, so each text is in the buckets of its bands, too. A signature has ``BANDS`` keys of ``ROWS`` minima each; two texts of similarity s share a key with probability
1 - (1 - s^ROWS)^BANDS, which is 0.9994 at s = 0.8 and more above. Texts of equal words are one node throughout.

No link goes unverified. Each bucket's members are first compared with its least node only, so a bucket of near copies costs
one comparison a member. What this leaves in different components is then compared pair by pair, so no colliding pair that
could join two components is passed over; pairs within a component can't change it and are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import columns_of, discard, masked, materialize, text_of
from .components import components
from .simhash import links as ball_links
from .simhash import majority, shingles

WORDS = 5
BANDS, ROWS = 32, 7
SEED = 42
_RND = np.random.default_rng(SEED)
_TIMES = _RND.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_PLUS = _RND.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band; the band's number is in the key."""
    import xxhash

    low, short = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 256):
        np.minimum(low, (short[k : k + 256, None] * _TIMES + _PLUS).min(axis=0), out=low)
    raw = low.tobytes()
    keys = np.array([xxhash.xxh64_intdigest(raw[4 * ROWS * b : 4 * ROWS * (b + 1)], b) for b in range(BANDS)], np.uint64)
    return keys.view(np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of at least 0.8 of two sorted arrays of distinct hashes; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def marked_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with _uid (of the row), _node (of its words), _size (distinct shingles), _fp (SimHash) and _keys (of the bands)."""
    held = docs.withColumn("_uid", F.monotonically_increasing_id())
    schema = StructType([*held.schema.fields, StructField("_node", LongType()), StructField("_size", LongType()), StructField("_fp", LongType()), StructField("_keys", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch, nodes, sizes, fps, keys = whole.slice(at, 512), [], [], [], []
                for t in batch.column("text"):
                    text = t.as_py() or ""
                    hashes = shingles(text, WORDS, SEED)
                    own = np.unique(hashes)
                    nodes.append(xxhash.xxh64_intdigest(b" ".join(text.encode().lower().split()), SEED))
                    sizes.append(len(own))
                    fps.append(majority(hashes))
                    keys.append(band_keys(own))
                signed = lambda xs: pa.array(np.array(xs, np.uint64).view(np.int64))
                more = [signed(nodes), pa.array(sizes, pa.int64()), signed(fps), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_node", "_size", "_fp", "_keys"])

    return held.mapInArrow(run, schema)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts are alike; ``texts`` has one row (node, text) a node."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, None
        for batch in batches:
            ok = []
            for node, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if node != last:  # rows come by b, as the join sorts them
                    last, other = node, np.unique(shingles(y.as_py(), WORDS, SEED))
                ok.append(alike(np.unique(shingles(x.as_py(), WORDS, SEED)), other))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(a, "a").join(b.hint("merge"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long")


def near_duplicate_groups(marked: DataFrame) -> DataFrame:
    """(node, root, best) of every node of ``marked``: its component, and the first of its rows as (no id, doc_id, text hash, uid)."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(text_of()).alias("text_hash"), "_uid")).alias("best")
    nodes = materialize(marked.groupBy(F.col("_node").alias("node")).agg(best), "near-nodes")
    first = nodes.select(F.col("best._uid").alias("_uid"))
    one = marked.join(first, "_uid", "left_semi")
    prints = materialize(one.select(F.col("_node").alias("node"), F.col("_size").alias("size"), F.col("_fp").alias("fp")), "near-prints")
    # Buckets are named by a fingerprint, which all its nodes have as a key, and those that ball hashing ties to it.
    tied = ball_links(materialize(prints.select("fp").distinct(), "near-fps")).select(F.col("a").alias("fp"), F.col("b").alias("key"))
    tied = prints.join(materialize(tied, "near-tied"), "fp").select("node", "size", "key")
    held = one.select(F.col("_node").alias("node"), F.col("_size").alias("size"), F.explode(F.concat("_keys", F.array("_fp"))).alias("key"))
    held = materialize(held.unionByName(tied), "near-keys")
    hubs = held.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1").select("key", "hub")
    shared = materialize(held.join(hubs.hint("merge"), "key"), "near-shared")
    texts = one.join(shared.select(F.col("node").alias("_node")).distinct(), "_node", "left_semi").select(F.col("_node").alias("node"), text_of().alias("text"))
    texts = materialize(texts, "near-texts")
    tried = materialize(shared.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "near-tried")
    links = materialize(verified(tried, texts), "near-links")
    # Members of a bucket that are in different components so far.
    roots = materialize(components(links), "near-roots")
    placed = shared.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    split = placed.groupBy("key").agg((F.min("root") != F.max("root")).alias("split")).where("split").select("key")
    placed = materialize(placed.join(split.hint("merge"), "key", "left_semi"), "near-split")
    sets = placed.select("key", "root").distinct()
    meets = sets.withColumnRenamed("root", "root_a").join(sets.withColumnRenamed("root", "root_b"), "key").where("root_a < root_b")
    side = lambda s: placed.select("key", F.col("root").alias(f"root_{s}"), F.col("node").alias(f"node_{s}"), F.col("size").alias(f"size_{s}"))
    # Sets whose sizes differ by more than a fifth can't be alike.
    met = meets.join(side("a"), ["key", "root_a"]).join(side("b"), ["key", "root_b"]).where("5 * least(size_a, size_b) >= 4 * greatest(size_a, size_b)")
    rest = met.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = materialize(verified(materialize(rest, "near-rest"), texts), "near-more")
    old, roots = roots, components(links.unionByName(more))
    discard(prints, held, shared, texts, tried, links, old, placed, more)
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "best")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of the least doc_id (ids before null, then by text hash) of each group of near duplicates in ``docs``.

    Groups are connected by texts of Jaccard similarity 0.8 or more. Rows are told apart by themselves, not by doc_id: rows
    without an id, or of one id, stay if their texts differ. Null, empty and wordless texts are one group. No rows give no rows.
    """
    rows = masked(docs, "doc_id", "text")
    marked = materialize(marked_rows(rows), "near-docs")
    kept = near_duplicate_groups(marked).groupBy("root").agg(F.min("best").alias("best")).select(F.col("best._uid").alias("_uid"))
    return marked.join(kept, "_uid", "left_semi").select(*columns_of(rows.columns)).toDF(*docs.columns)
