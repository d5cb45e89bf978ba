"""The pipeline's near-duplicate and mixing stages against brute force."""

import random

from engram.llm import neardup, simhash
from tests.llm.test_operators import AWKWARD, WORD, frame


def _shingles(t):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _edited(rnd, text, n):
    w = text.split(" ")
    for i in rnd.sample(range(len(w)), n):
        w[i] = f"edit{rnd.random()}"
    return " ".join(w)


def test_groups_equal_brute_force(spark):
    rnd = random.Random(9)
    words = [f"v{i}" for i in range(400)]
    texts = list(AWKWARD)
    for _ in range(12):
        base = " ".join(rnd.choices(words, k=100))
        texts += [base, _edited(rnd, base, 1), _edited(rnd, base, 1), _edited(rnd, base, 9)]
    for _ in range(6):  # chains, and members of a bucket that only link to others than its hub
        texts.append(_edited(rnd, texts[-1], 1))
    sets = [_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = sorted(r.doc_id for r in neardup.one_of_each(frame(spark, texts)).collect())
    assert got == sorted({find(i) for i in range(len(texts))})


def test_ball_hashing_finds_copies_without_bands(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(11)
    base = " ".join(rnd.choices([f"v{i}" for i in range(400)], k=1500))
    close = next(t for t in (_edited(rnd, base, 1) for _ in range(50)) if 0 < (simhash.fingerprint(t, 5) ^ simhash.fingerprint(base, 5)).bit_count() <= 3)
    far = _edited(rnd, base, 700)
    marked = neardup.marked_rows(frame(spark, [base, close, far])).withColumn("_keys", F.array().cast("array<bigint>"))
    groups = neardup.near_duplicate_groups(marked).groupBy("root").agg(F.min("best.doc_id").alias("first")).collect()
    assert sorted(r["first"] for r in groups) == [0, 2]


def test_stages_keep_rows_without_or_with_shared_ids(spark):
    import corpus_pipeline

    rnd = random.Random(10)
    texts = [" ".join(f"q{rnd.random()}" for _ in range(60)) for _ in range(5)]
    docs = frame(spark, [*texts, texts[0]], [None, None, None, 7, 7, 8])
    out = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted(r.text for r in out.collect()) == sorted(texts)
    assert {r.doc_id for r in out.where(out.text == texts[0]).collect()} == {8}
    mixed = corpus_pipeline.mixing_stage(spark, out, "")
    assert 0 < mixed.count() <= 2 * len(texts)
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), "").collect() == []
