"""The action fold against a plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators import fold
from engram.sources.adapters import checkpointed

FACTS = "place long, action string, summary string, details string, type string, target_id string, confidence double, vec array<double>"
MEMORIES = "id string, type string, summary string, details string, scope_glob string, triggers array<string>, status string, activation_class string, confidence double, importance double, vec array<double>"


def plain(facts, memories, threshold):
    now = {m[0]: dict(status=m[6], confidence=m[8], vec=m[10], old=m) for m in memories}
    outcomes, created, touched = [], [], set()
    for place, action, summary, details, kind, target, confidence, vec in sorted(facts):
        name = f"n{place:019}"
        if action == "create":
            pool = [m["vec"] for m in now.values() if m["status"] in ("active", "candidate") and m["vec"] is not None]
            if vec is not None and any(round(float(np.dot(vec, v)), 9) > threshold for v in pool):
                outcomes.append((place, action, None, True, "Duplicate"))
                continue
            now[name] = dict(status="candidate", confidence=confidence, vec=vec, old=None)
            created.append((name, kind or "workflow", "**/*", "scoped", round(0.7 if confidence is None else confidence, 9), 0.7, None))
            outcomes.append((place, action, name, False, None))
        elif target is None or target not in now or now[target]["old"] is None:
            outcomes.append((place, action, target, True, "No target" if target is None else "Target not found"))
        else:
            m = now[target]
            touched.add(target)
            if action == "reinforce":
                m["confidence"] = min(0.99, m["confidence"] + 0.05)
            elif action == "stale":
                m["status"] = "stale"
            else:
                m["status"] = "superseded"
                old = m["old"]
                now[name] = dict(status="candidate", confidence=0, vec=vec, old=None)
                created.append((name, kind or old[1], old[4], old[7], round(m["confidence"] if confidence is None else confidence, 9), old[9], target))
            outcomes.append((place, action, name if action == "supersede" else target, False, None))
    return outcomes, sorted((i, now[i]["status"], round(now[i]["confidence"], 9)) for i in touched), sorted(created)


@pytest.mark.parametrize("seed", [1])
def test_random_facts(spark, seed):
    rng = random.Random(seed)
    angle = lambda: (lambda a: [round(float(np.cos(a)), 6), round(float(np.sin(a)), 6)])(rng.choice([rng.random() * 6.3, rng.choice([0.1, 0.12, 2.0])]))
    memories = [(f"m{i}", rng.choice(["policy", "decision"]), "s", "d", f"g{i}", ["before_model"], rng.choice(["active", "candidate", "stale"]), "startup", rng.choice([0.5, 0.9, 1.0]), 0.3, rng.choice([None, angle()])) for i in range(12)]
    facts = []
    for k in range(160):
        action = rng.choice(["create"] * 4 + ["reinforce", "supersede", "stale"])
        target = rng.choice([None, "nobody", *(f"m{i}" for i in range(12)), "m0", "m0"])
        facts.append((k * 3, action, f"fact {k}", "d", rng.choice([None, "pitfall"]), target, rng.choice([None, 0.4]), rng.choice([None, angle(), angle(), angle()])))
    df = spark.createDataFrame(rng.sample(facts, len(facts)), FACTS)
    got = fold.apply_actions(df, spark.createDataFrame(memories, MEMORIES), checkpointed, 0.98, groups=3)
    outcomes, changed, created = plain(facts, memories, 0.98)
    assert sorted(map(tuple, got.outcomes.collect())) == sorted(outcomes, key=lambda r: r[0])
    assert sorted(map(tuple, got.changed.withColumn("confidence", F.round("confidence", 9)).collect())) == changed
    some = got.created.select("id", "type", "scope_glob", "activation_class", F.round("confidence", 9), "importance", "supersedes_id")
    assert sorted(map(tuple, some.collect())) == created


def test_no_facts(spark):
    got = fold.apply_actions(spark.createDataFrame([], FACTS), spark.createDataFrame([], MEMORIES), checkpointed)
    assert [df.count() for df in got] == [0, 0, 0]




@pytest.mark.parametrize("shape", ["chain", "ladder", "random", "star"])
def test_settle(spark, shape):
    rng = random.Random(7)
    if shape == "chain":
        edges = [(i + 1, i) for i in range(1500)]
    elif shape == "ladder":
        edges = [(i, i - d) for i in range(2, 24) for d in (1, 2)]
    elif shape == "star":
        edges = [(i, 0) for i in range(1, 300)]
    else:
        edges = [tuple(sorted(rng.sample(range(60), 2), reverse=True)) for _ in range(110)]
    n = []

    def save(df):
        n.append(1)
        return checkpointed(df)

    got = {r.node: r.chosen for r in fold.settle(spark.createDataFrame(edges, "node long, earlier long"), save).collect()}
    want, seen = {}, {}
    for v, u in edges:
        seen.setdefault(v, set()).add(u)
    for v in sorted({x for e in edges for x in e}):
        want[v] = not any(want[u] for u in seen.get(v, ()))
    assert got == want
    if shape == "chain":
        assert len(n) < 40  # as many tables as the logarithm of the chain's length, not as its links


def test_earlier_count(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), p, rng.random() < 0.5) for p in rng.sample(range(1000), 200)]
    got = fold.earlier_count(spark.createDataFrame(rows, "key string, place long, hit boolean"), "key", parts=7)
    assert {(r.key, r.place): r.n_before for r in got.collect()} == {(k, p): sum(h for k2, p2, h in rows if k2 == k and p2 < p) for k, p, _ in rows}
