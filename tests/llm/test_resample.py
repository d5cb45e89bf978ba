"""Importance resampling against a plain loop."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from engram.llm import resample as rs

BREAKS = re.compile(rs.BREAKS)


def words(text):
    return [w for w in BREAKS.split((text or "").translate(str.maketrans(rs.UPPER, rs.LOWER))) if w]


def plain(rows, target, orders, buckets, percent, least_words, seed):
    def found(text):
        ws = words(text)
        return [zlib.crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(orders[0], orders[1] + 1) for i in range(len(ws) - n + 1)]

    s, t = Counter(b for _, x in rows for b in found(x)), Counter(b for x in target for b in found(x))
    all_s, all_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for i, x in rows:
        own = found(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        out.append([i, len(words(x)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = able[: len(able) * percent // 100]
    place = {}
    for k, r in enumerate(drawn, 1):
        place.setdefault(id(r), k)
    return sorted(repr((*r, place.get(id(r)))) for r in out)


@pytest.mark.parametrize("orders", [(1, 1), (1, 3), (2, 2)])
def test_resample(spark, orders):
    rng = random.Random(12)
    pool = [f"w{k}" for k in range(40)] + ["Éa", "x-y", "7z", "Ünder", "İ"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(40)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "..."), (203, "solo"), (None, " ".join(pool)), (None, " ".join(pool)), (5, " ".join(pool)), (204, "big " * 30_000)]
    rows += [rows[7]] * 3
    target = [" ".join(pool[:20]), None, "", "w1 w2 w3"]
    docs = spark.createDataFrame([(i, x, 1) for i, x in rows], "doc_id long, text string, rank int").repartition(5)
    got = rs.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), orders, buckets=64, percent=30, least_words=5, seed=3)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain(rows, target, orders, 64, 30, 5, 3)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert rs.resample(none, some).count() == 0
    assert {(r.doc_id, r.n_features, r.rank) for r in rs.resample(some, none, percent=100, least_words=0).collect()} == {(1, 3, 1), (2, 0, None)}
    with pytest.raises(ValueError):
        rs.resample(some, none, orders=(2, 1))
