"""Statistics of scores against plain loops."""

import numpy as np

from engram.operators import similarity
from engram.sources.adapters import checkpointed


def tables(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 7)
    monkeypatch.setattr(similarity, "QUERIES", 5)
    monkeypatch.setattr(similarity, "BINS", 16)
    rng = np.random.default_rng(3)
    rows = [(i, [0, 1, 2, None][int(rng.integers(4))], (rng.normal(size=4) * 3).tolist()) for i in range(90)]
    rows += [(90, 1, None), (91, 1, [1.0, 2.0]), (92, 2, rows[0][2]), (93, 9, [0.0] * 4), (None, 1, [1.0] * 4)]
    queries = [r for r in rows if r[0] is not None and r[0] % 4 == 0] + [(91, 1, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "id long, label int, vec array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, own int, vec array<double>").repartition(2)
    dot = lambda a, b: float(np.dot(a, b)) if a and b and len(a) == len(b) else 0.0
    pairs = [(own, label, dot(a, b)) for i, own, a in queries for j, label, b in rows if j is not None and i != j]
    return q, v, pairs


def test_distribution(spark, monkeypatch):
    q, v, pairs = tables(spark, monkeypatch)
    got = {r.label: tuple(r)[1:] for r in similarity.distribution(q.drop("own"), v, checkpointed).collect()}
    assert set(got) == {0, 1, 2, 9, None}
    for label, row in got.items():
        s = np.round([x for _, k, x in pairs if k == label], 9)
        assert row[-1] == len(s)
        assert np.allclose(row[:-1], [s.mean(), np.median(s), s.std(), s.min(), s.max()], atol=2e-6)
    assert similarity.distribution(q.limit(0), v, checkpointed).collect() == []


def test_gap(spark, monkeypatch):
    q, v, pairs = tables(spark, monkeypatch)
    same = [x for a, b, x in pairs if None not in (a, b) and a == b]
    other = [x for a, b, x in pairs if None not in (a, b) and a != b]
    want = [np.mean(same), np.mean(other), np.mean(same) - np.mean(other), np.std(same), np.std(other), min(same), max(other)]
    assert np.allclose(list(similarity.gap(q, v, checkpointed).first()), want, atol=2e-6)


def test_no_row_a_pair(spark):
    """The plan has no node that lists pairs: what comes out of a pair of blocks is one row."""
    n = 400
    v = spark.range(n).selectExpr("id", "cast(id % 2 as int) label", "array(cast(id as double), 1d) vec")
    q = v.selectExpr("id query_id", "label own", "vec")
    qb, vb = similarity.blocks(q, v, checkpointed)
    assert similarity._moments(similarity._pairs(qb, vb), 9).count() == qb.where("_part = 0").count() * vb.count() < n
