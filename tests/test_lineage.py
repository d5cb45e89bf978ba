"""Depth-first descendants against a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from engram.operators import lineage, ordered
from engram.sources.adapters import checkpointed, stored


def plain(rows, focus):
    below = {}
    for i, parent, at in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        below.setdefault(parent, []).append(i)
    out, seen, stack = [], {focus}, [(c, 1) for c in reversed(below.get(focus, []))]
    while stack:
        node, depth = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        out.append((focus, len(out) + 1, node, depth))
        stack += [(c, depth + 1) for c in reversed(below.get(node, []))]
    return out


def walked(spark, rows, focuses):
    places = checkpointed(lineage.positions(spark.createDataFrame(rows, "id string, supersedes_id string, created_at int").repartition(3), checkpointed))
    got = lineage.descendants(places, spark.createDataFrame([(f,) for f in focuses], "id string"))
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("kind", ["forest", "cycles"])
def test_random_graphs(spark, kind, monkeypatch):
    monkeypatch.setattr(lineage, "BIN", 4)
    rng = random.Random(len(kind))
    ids = [f"n{i:03}" for i in rng.sample(range(1000), 120)]
    rows = []
    for k, i in enumerate(ids):
        parent = rng.choice([None, "nobody", i, *ids[:k], *ids[:k]]) if kind == "forest" else rng.choice(ids[: k + 1] + [ids[(k * 7 + 1) % 120]] * 3 + [None])
        rows.append((i, parent, rng.choice([None, *range(5)])))
    if kind == "cycles":  # a branched one, one of two and one of a node itself
        rows += [("a", "b", 1), ("b", "c", 2), ("c", "a", 3), ("x", "b", 0), ("y", "x", 1), ("z", "c", 9), ("w", "a", 5), ("p", "q", 1), ("q", "p", 1), ("self", "self", 1), ("t", "self", 1)]
        ids = [r[0] for r in rows]
    assert walked(spark, rows, ids) == sorted(r for i in ids for r in plain(rows, i))


def test_a_long_chain_and_a_wide_node(spark):
    chain = [(f"c{i:05}", f"c{i - 1:05}" if i else None, 0) for i in range(10_000)]
    wide = [("hub", None, 0)] + [(f"w{i:04}", "hub", i % 7) for i in range(2000)]
    n = []

    def save(df):
        n.append(1)
        return checkpointed(df)

    rows = spark.createDataFrame(chain + wide, "id string, supersedes_id string, created_at int")
    places = checkpointed(lineage.positions(rows, save))
    assert len(n) < 60
    last = places.where("id = 'c09999'").first()
    assert (last.pos, last.depth, last["size"], last.root) == (9999, 9999, 1, "c00000")
    got = lineage.descendants(places, spark.createDataFrame([("c09900",), ("hub",)], "id string"))
    assert sorted(map(tuple, got.collect())) == sorted(plain(chain, "c09900") + plain(wide, "hub"))


def test_no_rows_and_previous(spark):
    assert lineage.positions(spark.createDataFrame([], "id string, supersedes_id string, created_at int"), checkpointed).count() == 0
    rng = random.Random(1)
    rows = [(rng.choice([None, "hot", "hot", "b"]), i) for i in rng.sample(range(5000), 400)]
    got = ordered.previous(spark.createDataFrame(rows, "k string, v int"), ["k", "v"], ["k", "v"], checkpointed).withColumn("prev", F.struct("prev.k", "prev.v")).collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    want = {v: (rows[i - 1] if i else (None, None)) for i, (_, v) in enumerate(rows)}
    assert {r.v: tuple(r.prev) for r in got} == want


def test_rounds_leave_no_constraints(spark):
    """What is saved between rounds has no constraints of the plan that made it, which would grow with the rounds, and no more partitions."""
    df = spark.range(10).selectExpr("id", "id + 1 as to", "id as n").where("to is not null and n < 7")
    for _ in range(3):
        df = stored(df.join(df.selectExpr("id as to", "to as next", "n as more"), "to").selectExpr("id", "next as to", "n + more as n").unionByName(df.where("n > 3")))
    assert df._jdf.queryExecution().optimizedPlan().constraints().size() == 0
    assert sorted(stored(spark.range(3)).toDF("id").collect()) == [(0,), (1,), (2,)]


def test_query_uses_stored_rounds(spark, monkeypatch):
    from engram.plans import changes

    monkeypatch.setattr(changes.src, "checkpointed", None)
    assert changes.lineage_preorder(spark, "/root/testdata/sf0.001").count() > 0
