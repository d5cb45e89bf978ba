"""Training-data operators against brute force, round trips and awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from engram.llm import imatch, jpeg, linededup, mixing, packing, pii, ppm, quality, recompression, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, component_id string, row string, rank string, at string, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(20000))
AWKWARD = [None, "", " \n\t", "a", "a", LONG, "one two three four five six\none two three four five six\nsolo", "x@y.org +12 345 678 9012", "ÄÖ 漢字 🙂 end", "same text here", "same text here"]


def frame(spark, texts, ids=None):
    rows = [(ids[i] if ids else i, t, None, None if i % 3 else "s", None, 1, "c", "r", "k", "a", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def random_texts(seed, n, vocabulary=60, lines=4):
    rnd = random.Random(seed)
    words = [f"v{i}" for i in range(vocabulary)]
    out = []
    for i in range(n):
        if out and i % 4 == 0:
            w = rnd.choice(out).split(" ")
            w[rnd.randrange(len(w))] = "edit"
            out.append(" ".join(w))
        else:
            out.append("\n".join(" ".join(rnd.choices(words, k=rnd.randint(0, 14))) for _ in range(rnd.randint(1, lines))))
    return out


OPERATORS = {
    "pack": lambda d: packing.pack(d),
    "substrings": lambda d: recompression.dedup_substrings(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "ppm": lambda d: ppm.score(d, ~ppm.held_out()),
    "imatch": lambda d: imatch.fingerprints(d),
    "mix": lambda d: mixing.mix(d),
    "pii": lambda d: pii.find(d),
    "sanitise": lambda d: pii.sanitise(d),
    "jpeg": lambda d: jpeg.media_columns(d),
    "lines": lambda d: linededup.dedup_lines(d),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_awkward_rows(spark, name):
    docs = frame(spark, AWKWARD, [None, *range(1, 9), 9, 9])  # a null id, and a repeated row
    assert OPERATORS[name](docs).collect()
    assert OPERATORS[name](docs.limit(0)).collect() == []


def test_packing(spark):
    special = ["<|endoftext|> hi", "a<|endoftext|><|endoftext|>", "<|endoftext", "tab\u00a0\u2003wide \u3000 end  ", "it's we'LL 12345 \x00\x85"]
    docs = frame(spark, [*AWKWARD, *random_texts(1, 40), *special])
    rows = packing.pack(docs, ids=True).collect()
    encode = packing.encoder(packing.default_vocabulary())
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_vocabulary())
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d in docs.collect():
        want = [*plain.encode(d.text or "", add_special_tokens=False).ids, 0]
        assert [*encode(d.text or "").tolist(), 0] == want
        parts = sorted(by[d.doc_id], key=lambda r: r.start)
        assert sum((list(p.ids) for p in parts), []) == want and {p.doc_tokens for p in parts} == {len(want)}
        assert all(p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p.ids)) for p in parts)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024


def test_substrings(spark):
    rnd = random.Random(2)
    words = [f"u{i}" for i in range(500)]
    shared = [rnd.choices(words, k=k) for k in (34, 35, 60, 200)]
    texts = [" ".join(rnd.choices(words, k=50) + rnd.choice(shared) + rnd.choices(words, k=rnd.randint(0, 50))) for _ in range(30)] + ["z " * 90, "z " * 36, " ".join(shared[2]), " ".join(shared[2])]
    count = Counter()
    split = [WORD.findall(t) for t in texts]
    for w in split:
        count.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    for r in recompression.dedup_substrings(frame(spark, texts)).collect():
        w = split[r.doc_id]
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        assert (r.n_words, r.n_removed) == (len(w), len(gone))
        assert r.kept_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()


def _fingerprint(t):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    texts = [*AWKWARD, *random_texts(3, 120, lines=8)]
    fps = [_fingerprint(t) for t in texts]
    # fingerprints at each distance, as links must not be lost
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for r in simhash.near_duplicates(frame(spark, texts)).collect():
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == find(r.doc_id)


def test_simhash_links_at_every_distance(spark):
    rnd = random.Random(4)
    rows, want = [], {}
    for _ in range(200):
        base = rnd.getrandbits(64)
        bits = rnd.sample(range(64), rnd.randint(1, 4))
        other = base
        for b in bits:
            other ^= 1 << b
        rows += [base, other]
        want[base] = len(bits) <= 3, other
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x), i) for i, x in enumerate(rows)], "fp long, doc_id long")
    from engram.llm.components import components

    roots = {r.node: r.root for r in components(simhash.links(df.select("fp"))).collect()}
    for base, (linked, other) in want.items():
        a, b = roots.get(signed(base), 1), roots.get(signed(other), 2)
        assert (a == b) is linked


def test_lines(spark):
    texts = [*AWKWARD, *random_texts(6, 60, vocabulary=25)]
    lines = [(i, k, frozenset(WORD.findall(x))) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    gone = {(i, k) for n, (i, k, a) in enumerate(lines) if any(5 * len(a & b) >= 4 * len(a | b) for _, _, b in lines[:n])}
    for r in linededup.dedup_lines(frame(spark, texts).select("doc_id", "text")).collect():
        t = texts[r.doc_id]
        kept = [x for k, x in enumerate((t or "").split("\n")) if (r.doc_id, k) not in gone]
        assert r.n_removed == sum(i == r.doc_id for i, _ in gone) and (r.text or "") == "\n".join(kept)


def test_line_crowds_and_tables(spark, monkeypatch):
    """Crowds of near copies are settled by hubs without loss, and the join writes few tables."""
    rnd, tables, real = random.Random(5), [], linededup.materialize

    def noted(df, name):
        out = real(df, name)
        tables.append((name, out.columns, out.count()))
        return out

    monkeypatch.setattr(linededup, "CROWD", 4)
    monkeypatch.setattr(linededup, "materialize", noted)
    texts = []
    for length in (6, 12, 30, 150):
        base = [f"w{length}x{k}" for k in range(length)]
        for _ in range(14):
            words = [f"z{rnd.randrange(40)}" if rnd.random() < 0.12 else w for w in base]
            rnd.shuffle(words)
            texts.append(" ".join(words) + "\n\t\n" + " ".join(rnd.choices(base, k=length)))
    lines = [(i, k, frozenset(WORD.findall(x))) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    gone = {(i, k) for n, (i, k, a) in enumerate(lines) if any(5 * len(a & b) >= 4 * len(a | b) for _, _, b in lines[:n])}
    got = linededup.dedup_lines(frame(spark, texts).select("doc_id", "text")).collect()
    assert gone and {r.doc_id: (r.n_lines, r.text) for r in got} == {
        i: (2, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in enumerate(texts)
    }
    assert len(tables) <= 24 and any(name == "line-crowded" and n for name, _, n in tables)


def test_ppm(spark):
    texts = [*AWKWARD, *random_texts(7, 80)]
    rows = {r.doc_id: r for r in ppm.score(frame(spark, texts), F.col("doc_id") % 7 != 2, least=0.0).collect()}
    words = lambda t: [*WORD.findall((t or "").lower()), "\0end"]
    count = Counter(w for i, t in enumerate(texts) if i % 7 != 2 for w in words(t))
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        w, r = words(t), rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0


def test_imatch(spark):
    rows = imatch.fingerprints(frame(spark, AWKWARD)).collect()
    assert rows[3].fingerprint == rows[4].fingerprint
    rows = {r.doc_id: r for r in imatch.op5_imatch(spark, SF).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    ids = sorted(docs)
    for k, i in enumerate(ids):
        t, nxt = docs[i], docs[ids[(k + 1) % len(ids)]]
        h = len(t) // 2
        assert rows[i].edited_sha256 == hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()
    assert sum(r.near_edited for r in rows.values()) > 3 * sum(r.near_next for r in rows.values())


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert all(r.taken <= 2 * r.size for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))
    total, largest = {}, {}
    for r in rows:
        total[r.source_size, r.target] = total.get((r.source_size, r.target), 0) + r.taken
        largest[r.source_size, r.target] = max(largest.get((r.source_size, r.target), 0), r.size)
    assert all(abs(taken - target) <= largest[size, target] for (size, target), taken in total.items())
    assert mixing.water_fill([10, 10, 10], [5, 2, 1], 1.5, 2.0) == [20.0, pytest.approx(50 / 3), pytest.approx(25 / 3)]
    flows = mixing.min_cost_flow([(10, (0,)), (10, (0, 1)), (10, (1,))], [15, 15], 2)
    assert [sum(f.get(s, 0) for f in flows) for s in (0, 1)] == [15, 15] and all(sum(f.values()) <= 10 for f in flows)


def test_mixing_of_overlapping_sources(spark):
    """A document may stand in several sources; the flow meets all quotas and takes second copies only where first ones run out."""
    rows = [(i, "w " * 10, ["a"] if i < 40 else ["a", "b"] if i < 60 else ["b"] if i < 62 else ["c"]) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own array<string>")
    out = {r.doc_id: r for r in mixing.mix(docs, sources=F.col("own"), weights=(2, 1, 1), share=0.5).collect()}
    # Sizes a 600, b 220, c 380; half of all is 600 words, by weight 300, 150, 150.
    assert sum(r.taken for r in out.values()) == 600 and all(r.repeats <= 1 for r in out.values())
    assert sum(out[i].taken for i in range(62, 100)) == 150
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5), sources=F.col("own"), weights=(2, 1, 1), share=0.5).collect()}
    assert again == {i: r.taken for i, r in out.items()}
    rnd = random.Random(3)
    for _ in range(30):  # the largest flow, by the least cut over all sets of sources
        sizes = [(rnd.randint(1, 30), tuple(sorted(rnd.sample(range(3), rnd.randint(1, 3))))) for _ in range(5)]
        quotas = [rnd.randint(1, 40) for _ in range(3)]
        flows = mixing.min_cost_flow(sizes, quotas, 2)
        cut = min(sum(quotas[s] for s in range(3) if not m >> s & 1) + sum(2 * n for n, own in sizes if any(m >> s & 1 for s in own)) for m in range(8))
        assert sum(sum(f.values()) for f in flows) == cut and all(sum(f.values()) <= 2 * n for f, (n, _) in zip(flows, sizes, strict=True))


def test_jpeg(spark):
    for r in jpeg.media_columns(frame(spark, AWKWARD), keep_media=True).collect():
        raw = (AWKWARD[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert b"".join(t.tobytes() for t in jpeg.thumbnails(list(jpeg.images(bytes(r.media))))) == payload


def test_quality(spark):
    rows = quality.op8_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.85


def test_quality_votes_equal_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").where(~quality.held_out()))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    axes, known, labels = model["axes"].astype(float), model["known"].astype(float), model["labels"]
    for d in docs.collect()[:60]:
        v = quality.terms(d.text or "").astype(float) @ axes
        norm = max(math.sqrt(sum(x * x for x in v)), 1e-12)
        near = sorted(((float(sum(a * b for a, b in zip(v / norm, k))), y) for k, y in zip(known, labels)), key=lambda x: -x[0])[:15]
        weight = [max(c, 1e-3) ** 16 for c, _ in near]
        assert math.isclose(got[d.doc_id], sum(w * y for w, (_, y) in zip(weight, near)) / sum(weight), abs_tol=2e-3)


def test_quality_of_awkward_rows(spark):
    docs = frame(spark, AWKWARD, [None, *range(1, 9), 9, 9]).selectExpr("*", "'x' as score")
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 1), (None, 1), (6, None), (99, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert len(model["labels"]) == 3
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[9]) == 1 and by[3] == by[4] and by[None] == by[1]  # equal texts, and null like empty
    kept = quality.accepted(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(AWKWARD) and {r.score for r in kept.collect()} == {"x"}
    none = quality.fit(docs.limit(0), labels)
    assert quality.score(docs.limit(0), none).collect() == [] and {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert {r.held for r in docs.where("doc_id is null").select(quality.held_out().alias("held")).collect()} == {True}


CLASHES = ("_id", "_row", "_removed", "_repeats", "_copy", "_text", "_key", "_spans", "_terms", "score", "_uid", "_node", "removed_lines", "mix_key", "mix_repeats", "place", "id", "n", "word", "hub")


def test_stages_with_clashing_names_and_awkward_rows(spark):
    import corpus_pipeline

    ids = [None, *range(1, 9), 9, 9]
    docs = frame(spark, AWKWARD, ids)
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHES), name
        assert stage(spark, docs.limit(0), SF).collect() == [], name
        if name == "lines":
            assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, ids))
            assert {r.doc_id: r.text for r in rows if r.doc_id is not None}[6] == "one two three four five six\nsolo" and [r.text for r in rows if r.doc_id is None] == [None]
        if name == "near_duplicates":
            assert len(rows) == 7  # one wordless, "a" once, "same text here" once


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert out.count() > 0
        docs = out
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_repeated_rows_are_mixed_each_on_its_own(spark):
    import corpus_pipeline
    from engram.llm import mixing

    text = ["a b c d e f", "g h i j", "k l"]
    rows = [(1 + k % 3 if k % 2 else None, text[k % 3], "en", f"s{k % 2}", 7, "x") for k in range(12)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, mix_row string").repartition(3)
    out = corpus_pipeline.mixing_stage(spark, docs, SF)
    assert out.columns == docs.columns
    numbered = spark.createDataFrame([(k, r[1], r[3]) for k, r in enumerate(rows)], "doc_id long, text string, source string")
    want = mixing.mix(numbered, carry=("source",)).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("target")).collect()
    got = {r.source: r.n for r in out.withColumn("n", F.size(F.split("text", " "))).groupBy("source").agg(F.sum("n").alias("n")).collect()}
    for r in want:  # as close to the target as one document allows, and no row more than twice
        assert abs(got[r.source] - r.target) <= 6, r
    times = {(r.doc_id, r.text, r.source): r.n for r in out.groupBy("doc_id", "text", "source").agg(F.count("*").alias("n")).collect()}
    have = {}
    for r in rows:
        have[(r[0], r[1], r[3])] = have.get((r[0], r[1], r[3]), 0) + 1
    assert all(n <= 2 * have[k] for k, n in times.items())
