"""The filter audit against a plain loop over all orders."""

import itertools
import math
import random

import pytest

from engram.llm import interaction as it


def plain(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    failing = []
    for i, text, source in rows:
        text = text or ""
        ws = text.split()
        bad = (len(ws) < 50, 100 * len(set(ws)) < 65 * len(ws), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text), i is not None and first[text] < i)
        failing.append((source or "", {f for f, b in zip("ABCDE", bad, strict=True) if b}, i in good, i in toxic))
    out = []
    for part in {p for p, *_ in failing}:
        own, total, steps = [x[1:] for x in failing if x[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                redundant = sum(f in x[0] for x in own) - len(gone)
                left = [x for x in left if f not in x[0]]
                total[f] += len(gone)
                steps.append((order, k, f, len(left), len(gone), redundant, sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        out += [(part, o, k, *rest, total[f]) for o, k, f, *rest in steps]
    return sorted(out)


def test_audit(spark):
    rng = random.Random(13)
    texts = [None, "", "  ", "a", "A" * 300, "one two # three", " ".join(map(str, range(60))), "x y " * 40, " ".join(f"W{i}" for i in range(55)), " ".join(f"w{i}|" for i in range(70)), "z" * 60_000]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["a", "b", "", None, "é"])) for _ in range(300)]
    rows += [rows[0], rows[1], rows[1]]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [None, *range(0, 40, 2), 4, 4, 900]]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, mask int, part string").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in it.audit(docs, known, it.CONDITIONS, "E").collect())
    assert got == plain(rows, labels)
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert it.audit(none, known, it.CONDITIONS, "E").count() == 0
    with pytest.raises(ValueError):
        it.audit(none, known, dict.fromkeys("ABCDEFG", "true"), "Z")


@pytest.mark.parametrize("k", [1, 2, 5])
def test_swaps_visit_every_order_once(k):
    order = list(range(k))
    seen = [tuple(order)]
    for j in it.swaps(k):
        order[j], order[j + 1] = order[j + 1], order[j]
        seen.append(tuple(order))
    assert len(seen) == len(set(seen)) == math.factorial(k)
