"""Connected components of a graph given as an edge table, by alternating large-star and small-star rounds.

Each round is a grouping and a join; its result is written to the shared folder, so lineage stays short and the join's skewed
partitions (the neighbours of a hub) can be split. Nothing but a count comes to the driver. Reference: Kiveris et al.,
"Connected components in MapReduce and beyond" (2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b); root is the least node of its component. Self-loops are allowed."""
    links = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        for large in (True, False):
            both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
            least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
            moved = both.join(least, "u")
            if large:  # larger neighbours go to the least
                new = moved.where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:  # smaller neighbours, and the node itself
                new = moved.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("u != m").select("u", F.col("m").alias("v")))
            used, links = links, materialize(new.distinct(), "links")
            discard(used, least)
        now = links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select("v").distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
