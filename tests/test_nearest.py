"""Exact nearest vectors against brute force."""

import numpy as np
import pytest

from engram.operators import nearest
from engram.sources.adapters import checkpointed


def plain(queries, vectors, k, dims):
    fit = lambda v: np.zeros(dims) if v is None or len(v) != dims else np.array(v)
    out = {}
    for q, x in queries:
        scored = sorted((-round(float(fit(x) @ fit(v)), nearest.DIGITS) + 0.0, i) for i, v in vectors if i != q)
        out[q] = [i for _, i in scored[:k]]
    return out


def run(spark, queries, vectors, k, kind="long", **more):
    q = spark.createDataFrame(queries, f"query_id {kind}, vec array<double>").repartition(3)
    v = spark.createDataFrame(vectors, f"id {kind}, vec array<double>").coalesce(1)
    rows = nearest.topk(q, v, k, checkpointed, **more).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.id)
    return got, {r.query_id: r.compared for r in rows}


@pytest.mark.parametrize("groups", [1, 12])
def test_clusters(spark, groups, monkeypatch):
    monkeypatch.setattr(nearest, "QUERIES", 7)
    rng = np.random.default_rng(1)
    homes = rng.normal(size=(12, 8)) * 5
    x = np.repeat(homes, 60, axis=0) + rng.normal(size=(720, 8)) * 0.05
    x[300:540] = x[300]  # a third are copies
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    queries = vectors[::20]
    got, compared = run(spark, queries, vectors, 5, groups=groups)
    assert got == plain(queries, vectors, 5, 8)
    if groups > 1:
        assert sum(compared.values()) < 0.5 * len(queries) * len(vectors)


def test_odd_vectors_and_no_rows(spark):
    vectors = [("a", [1.0, 0.0]), ("b", [0.5, 0.5]), ("c", None), ("d", [1.0]), ("e", [-1.0, 0.0]), ("f", [0.0, 0.0]), ("g", []), ("h", [0.5, 0.5])]
    queries = [*vectors[:3], ("new", [2.0, 1.0]), ("short", [1.0])]
    for groups in (1, 4):
        got, _ = run(spark, queries, vectors, 4, "string", groups=groups)
        assert got == plain(queries, vectors, 4, 2)
        assert run(spark, queries, vectors, 100, "string", groups=groups)[0] == plain(queries, vectors, 100, 2)
    assert run(spark, [], vectors, 3, "string")[0] == {} == run(spark, queries, [], 3, "string")[0]
    with pytest.raises(ValueError):
        run(spark, queries, vectors, 3, "string", groups=5000)
