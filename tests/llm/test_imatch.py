"""Fingerprints of copied and of rare texts."""

import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from engram.llm import imatch
from tests.llm.test_operators import AWKWARD, SF, WORD, frame, random_texts


def test_copies_and_rare_texts_have_fingerprints(spark):
    texts = ["copied words here"] * 40 + ["rare alpha"] + ["unlike beta"] + ["", " \n"] + random_texts(5, 60)
    rows = {r.doc_id: r.fingerprint for r in imatch.fingerprints(frame(spark, texts)).collect()}
    blank = ".".join("-" * 32)
    assert all((rows[i] == blank) == (not t.split()) for i, t in enumerate(texts))
    assert len({rows[i] for i in range(40)}) == 1 and len({rows[0], rows[40], rows[41]}) == 3
    pairs = spark.createDataFrame([(rows[40], rows[41]), (rows[0], rows[1]), (rows[42], rows[43])], "a string, b string")
    got = pairs.select(imatch.likeness(F.split("a", r"\."), F.split("b", r"\.")).alias("x")).collect()
    assert [r.x for r in got] == [0.0, 1.0, 1.0]


def test_lexicon_counts_distinct_texts(spark):
    texts = ["hot pair one", "hot pair two"] * 20 + [f"own{i} text{i}" for i in range(40)]
    terms = set(imatch.lexicon(frame(spark, texts)).first().terms)
    hot = spark.range(1).select(F.xxhash64(F.lit("hot"))).first()[0]
    assert hot in terms  # in 2 of 42 distinct texts, though in half of the rows


def _long(x, seed=42):
    return xxhash.xxh64_intdigest(struct.pack("<q", x), seed)


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _hash_all(xs):
    h = 42
    for x in xs:
        h = _long(x, h)
    return f"{h:x}"


def _plain(texts):
    """Fingerprints by plain loops: document frequencies over distinct texts, band, subsets, sorted terms."""
    terms = [{_signed(xxhash.xxh64_intdigest(w.lower(), 42)) for w in WORD.findall(t)} for t in texts]
    df = Counter(x for t in {t: s for t, s in zip(texts, terms)}.items() for x in t[1])
    n = len(set(texts))
    lexicon = {x for x, c in df.items() if c >= 2 and n * 0.005 <= c <= n * 0.1}
    out = []
    for own in terms:
        slots = []
        for rate, subsets in imatch.SUBSETS:
            for k in range(subsets):
                part = [x for x in sorted(own & lexicon) if _signed(xxhash.xxh64_intdigest(struct.pack("<i", rate * 1000 + k), _long(x))) % rate == 0]
                slots.append(_hash_all(part) if part else "-")
        if own and set(slots) == {"-"}:
            slots[0] = _hash_all(sorted(own))
        out.append(slots)
    return out


def test_fingerprints_equal_plain_loops(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    texts = [r.text or "" for r in sorted(rows, key=lambda r: r.doc_id)] + [t or "" for t in AWKWARD if not t or t.isascii()]
    want = _plain(texts)
    got = {r.doc_id: r.fingerprint.split(".") for r in imatch.fingerprints(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    clash = frame(spark, texts[:3]).selectExpr("*", "'x' as lexicon_terms", "'y' as _terms")
    assert {(r.lexicon_terms, r._terms) for r in imatch.fingerprints(clash).collect()} == {("x", "y")}


def test_likeness_of_all_neighbours(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = {r.doc_id: r for r in imatch.op5_imatch(spark, SF).collect()}
    ids = sorted(docs)
    for k, i in enumerate(ids):
        r, nxt = rows[i], rows[ids[(k + 1) % len(ids)]]
        for mine, theirs, value in ((r.fingerprint, r.edited_fingerprint, r.near_edited), (r.fingerprint, nxt.fingerprint, r.near_next)):
            used = [(a, b) for a, b in zip(mine.split("."), theirs.split("."), strict=True) if (a, b) != ("-", "-")]
            assert value == (sum(a == b for a, b in used) / len(used) if used else 1.0)


def test_lexicon_exchanges_a_word_once_a_text(spark):
    docs = spark.createDataFrame([(0, "A b a"), (1, "a B b"), (2, "a  b b b"), (3, "A b a")], "doc_id long, text string")
    found = imatch.lexicon(docs, 0.0, 1.0)
    assert "first(array_join(array_sort(array_distinct(" in found._jdf.queryExecution().optimizedPlan().toString()
    assert len(found.first().terms) == 2
