"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). The flow network is

    start -> pattern -> source of the pattern -> end

with one arc from the start for each repetition of a pattern's words, at costs 0, 1, 3, 5, ... (differences of squares, so
cost is convex in repetitions and a second copy is taken only where first copies do not suffice), and the source's quota
on its last arc. The network has patterns and sources for nodes, never documents; the driver solves it. Documents of a
pattern are then taken by a seeded hash order: all of them for every full repetition, and for the rest the first ones
until the flow is reached, to the nearest document.

That order is cut without a global sort: words are summed by hash bucket, the bucket in which the quota ends is found
from those sums, and only that bucket's documents are ordered one by one.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize, read, text_of

BUCKETS = 4096


def water_fill(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Targets by weight of ``share`` of all sizes; none above ``cap`` times its size, the excess goes to the others."""
    left, targets, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] / total > cap * sizes[i]}
        for i in full or free:
            targets[i] = cap * sizes[i] if full else left * weights[i] / total
        if not full:
            break
        left -= sum(targets[i] for i in full)
        free -= full
    return targets


def min_cost_flow(patterns: list[tuple[int, tuple[int, ...]]], quotas: list[int], repeats: int) -> list[dict[int, int]]:
    """Words each pattern (size, sources) sends to each source: a largest flow of least cost, by successive shortest paths."""
    n, m = len(patterns), len(quotas)
    start, end = n + m, n + m + 1
    arcs: list[list] = []  # to, room, cost; the reverse of arc k is k ^ 1
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def add(a: int, b: int, room: int, cost: int) -> None:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            out[x].append(len(arcs))
            arcs.append([y, r, c])

    for p, (size, sources) in enumerate(patterns):
        for r in range(repeats):
            add(start, p, size, 2 * r - 1 if r else 0)
        for s in sources:
            add(p, n + s, size * repeats, 0)
    for s, q in enumerate(quotas):
        add(n + s, end, q, 0)
    while True:
        cost, via, todo = {start: 0}, {}, deque([start])
        while todo:
            a = todo.popleft()
            for k in out[a]:
                b, room, c = arcs[k]
                if room > 0 and cost[a] + c < cost.get(b, 1 << 60):
                    cost[b], via[b] = cost[a] + c, k
                    todo.append(b)
        if end not in cost:
            break
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = arcs[via[at] ^ 1][0]
        amount = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= amount
            arcs[k ^ 1][1] += amount
    sent: list[dict[int, int]] = [{} for _ in patterns]
    for p in range(n):
        for k in out[p]:
            if k % 2 == 0 and n <= arcs[k][0] < n + m and arcs[k ^ 1][1]:
                sent[p][arcs[k][0] - n] = arcs[k ^ 1][1]
    return sent


def mix(
    docs: DataFrame,
    sources: Column | None = None,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 0,
    max_patterns: int = 20_000,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How many words of each of ``docs`` the mix takes: doc_id, size, source_size, target, taken, repeats.

    ``sources``: an array of the sources of a document (by default its ``source`` alone; null is a source of its own, last in
    order). ``weights`` repeat over the sources in code-point order. Size: words of the text; a null or empty text has 0 and
    is never taken. source_size and target: sums over the document's sources. Repeated rows are rows of their own; a null
    doc_id stays; equal doc_ids are ordered by size, then by the columns ``carry``, which come out again. The driver holds one row per pattern; more than ``max_patterns`` is an
    error, not a cut. No rows give no rows.
    """
    members = F.array(F.col("source")) if sources is None else sources
    sized = materialize(
        docs.select(
            "doc_id",
            *carry,
            F.array_sort(F.array_distinct(members)).alias("pattern"),
            F.size(F.array_remove(F.split(text_of(), SPACE), "")).cast("long").alias("size"),
        ).select("*", F.xxhash64("doc_id", F.lit(seed)).alias("rank")).withColumn("bucket", F.pmod("rank", F.lit(BUCKETS)).cast("int")),
        "mix-sizes",
    )
    found = sized.groupBy("pattern").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    names = sorted({s for row in found for s in row.pattern}, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(names)}
    patterns = [(row.size, tuple(place[s] for s in row.pattern)) for row in found]
    sizes = [0] * len(names)
    for size, own in patterns:
        for s in own:
            sizes[s] += size
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(names))], share, cap)
    sent = min_cost_flow(patterns, [round(t) for t in targets], int(cap))
    plan_rows = [
        (row.pattern, sum(sizes[s] for s in own), float(sum(targets[s] for s in own)), *divmod(sum(flow.values()), size or 1))
        for row, (size, own), flow in zip(found, patterns, sent, strict=True)
    ]
    kind = sized.schema["pattern"].dataType.simpleString()
    plan = sized.sparkSession.createDataFrame(plan_rows, f"pattern {kind}, source_size long, target double, full long, rest long")
    same = lambda a, b: a["pattern"].eqNullSafe(b["pattern"])
    sums = sized.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    edges = [  # one row a pattern
        (row.pattern, row.bucket, row.need)
        for row in sums.join(F.broadcast(plan), same(sums, plan))
        .where("before < rest and before + words >= rest")
        .select(sums.pattern, "bucket", (F.col("rest") - F.col("before")).alias("need"))
        .collect()
    ]
    edge = sized.sparkSession.createDataFrame(edges, f"pattern {kind}, edge int, need long")
    plan = plan.join(F.broadcast(edge), same(plan, edge), "left").select(plan.pattern, "source_size", "target", "full", F.coalesce("edge", F.lit(-1)).alias("edge"), F.coalesce("need", F.lit(0)).alias("need"))
    rows = sized.join(F.broadcast(plan), same(sized, plan)).drop(plan.pattern)
    sure = rows.where("bucket != edge").withColumn("more", (F.col("bucket") < F.col("edge")).cast("long"))
    order = Window.partitionBy("pattern").orderBy("rank", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, 0)
    at_edge = (
        rows.where("bucket = edge")
        .withColumn("upto", F.sum("size").over(order))
        .withColumn("more", (F.col("upto") - F.col("size") / 2 <= F.col("need")).cast("long"))
        .drop("upto")
    )
    repeats = F.when(F.col("size") > 0, F.col("full") + F.col("more")).otherwise(F.lit(0)).alias("repeats")
    return (
        sure.unionByName(at_edge)
        .select("doc_id", *carry, "size", "source_size", "target", repeats)
        .select("doc_id", *carry, "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")
    )


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))
