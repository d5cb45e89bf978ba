"""Glob and interval joins against all pairs, and their plans."""

import datetime as dt
import random
import re

import pytest

from engram.functions.text import glob_regex, normal_path
from engram.operators import globs, modes
from engram.plans.catalog import QUERIES
from engram.sources.adapters import checkpointed
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_random_globs(spark):
    rng = random.Random(6)
    part = lambda: rng.choice(["src", "a", "b.ts", "x{1,2}", "*", "**", "?", "*.ts", "a*", "x1", "[ab]"])
    some = sorted({rng.choice(["", "/", "./"]) + "/".join(part() for _ in range(rng.randrange(1, 5))) for _ in range(120)} | {"", "**/*", "src\\a\\*", "src//a", "{src,a}/b.ts", "src/{a/b.ts,x1}"})
    paths = sorted({rng.choice(["", "/", "./"]) + "/".join(rng.choice(["src", "a", "b.ts", "x1", "x2", "deep"]) for _ in range(rng.randrange(1, 5))) for _ in range(60)} | {"", ".", "src\\a\\b.ts"})
    g, p = spark.createDataFrame([(x,) for x in [*some, None]], "glob string"), spark.createDataFrame([(x,) for x in [*paths, None]], "path string")
    got = {tuple(r) for r in globs.matches(g, p).collect()}
    want = g.crossJoin(p).where(F.regexp_like(normal_path(F.col("path")), glob_regex(F.col("glob"))))
    assert got == {tuple(r) for r in want.collect()} and len(got) > 100


@pytest.mark.parametrize("name", ["trigger_scope_gate", "activate_default_scored", "policy_warnings"])
def test_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|Cartesian", plan)


def test_windows(spark):
    rng = random.Random(8)
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    sums = [(i, at(rng.choice([0, 5, 5, 9, 400, rng.randrange(3000)]))) for i in range(30)]
    chosen = [(q, i, t, "x") for q in range(3) for i, t in rng.sample(sums, 8)]
    rows = [(rng.randrange(4), k, at(rng.choice([-500, 5, 9, rng.randrange(4000)]))) for k in range(300)]
    s = spark.createDataFrame(sums, "session_id long, created_at timestamp_ntz")
    c = spark.createDataFrame(chosen, "request_id long, session_id long, ended_at timestamp_ntz, tag string")
    w = modes.with_start(c, s, checkpointed)
    order = sorted(sums, key=lambda r: (r[1], r[0]))
    before = {i: (order[k - 1][1] if k else None) for k, (i, _) in enumerate(order)}
    assert {(r.request_id, r.session_id): r.start_at for r in w.collect()} == {(q, i): before[i] for q, i, _, _ in chosen}
    for parts in (1, 7, 1024):
        got = modes.in_windows(spark.createDataFrame(rows, "request_id long, id long, created_at timestamp_ntz"), w, checkpointed, parts)
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
        want = sorted((q, k, i) for q, k, t in rows for q2, i, end, _ in chosen if q == q2 and (before[i] is None or t > before[i]) and t <= end)
        assert sorted((r.request_id, r.id, r.session_id) for r in got.collect()) == want
    assert modes.in_windows(spark.createDataFrame(rows, "request_id long, id long, created_at timestamp_ntz"), w.limit(0), checkpointed).count() == 0
