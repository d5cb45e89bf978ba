"""Versioned tables and the stored index."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from engram.operators import hybrid, index
from engram.plans import indexes
from engram.plans.catalog import QUERIES, SQL
from engram.sources import adapters
from engram.sources.store import Conflict


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def store(spark):
    return adapters.store(spark, "test-store")


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, status string, vector array<double>, created_at int")


def test_versions_read_back(spark, store):
    old = [(f"m{i}", "active", [float(i)], i) for i in range(40)] + [("none", None, None, None)]
    assert store.create("m", frame(spark, old), ("id",), buckets=8) == 1
    with pytest.raises(Conflict):
        store.create("m", frame(spark, old), ("id",))
    assert store.insert("m", frame(spark, [("m1", "ignored", None, 9), ("new", "b", None, 2), ("new", "a", None, 1)])) == 2
    assert store.update("m", spark.createDataFrame([("m2", "stale", None), ("m3", None, 7), ("nobody", "x", 1)], "id string, status string, created_at int")) == 3
    assert store.upsert("m", frame(spark, [("m4", "again", None, 99), ("m5", "again", [0.5], 99), ("late", "again", None, 99)]), keep=("created_at",), fill=("vector",)) == 4
    assert store.delete("m", spark.createDataFrame([("m6",), ("nobody",)], "id string")) == 5
    assert rows_of(store.read("m", 1)) == sorted(old, key=repr)
    want = {r[0]: r for r in old} | {"new": ("new", "a", None, 1)}
    assert rows_of(store.read("m", 2)) == sorted(want.values(), key=repr)
    want |= {"m2": ("m2", "stale", [2.0], 2), "m3": ("m3", "active", [3.0], 7)}
    assert rows_of(store.read("m", 3)) == sorted(want.values(), key=repr)
    want |= {"m4": ("m4", "again", [4.0], 4), "m5": ("m5", "again", [0.5], 5), "late": ("late", "again", None, 99)}
    assert rows_of(store.read("m", 4)) == sorted(want.values(), key=repr)
    del want["m6"]
    assert rows_of(store.read("m")) == sorted(want.values(), key=repr)
    # Only the buckets of the changed keys have other files.
    a, b = (store.manifest(v)["m"]["folders"] for v in (4, 5))
    assert sum(a.get(k) != b.get(k) for k in {*a, *b}) <= 2


def test_a_failed_writer_leaves_no_version(spark, store):
    store.create("m", frame(spark, [("a", "x", None, 1)]), ("id",), buckets=4)
    bad = frame(spark, [("a", "y", None, 1)]).selectExpr("id", "status", "vector", "if(assert_true(created_at > 5) is null, 1, 2) as created_at")
    with pytest.raises(Exception, match="created_at|assert"):
        store.upsert("m", bad)
    assert store.head() == 1 and rows_of(store.read("m")) == [("a", "x", None, 1)]
    assert store.change("m", frame(spark, []), lambda old, new: old) == 1


def test_two_writers(spark, store):
    keys = [f"k{i}" for i in range(60)]
    store.create("m", frame(spark, [(k, "x", None, 0) for k in keys]), ("id",), buckets=4)
    base, entry = store.head(), store.manifest()["m"]
    place = {k: store.touched(spark.createDataFrame([(k,)], "id string"), ("id",), 4)[0] for k in keys[:12]}
    first = keys[0]
    other = next(k for k in keys[:12] if place[k] != place[first])
    same = next(k for k in keys[1:12] if place[k] == place[first])
    assert entry["buckets"] == 4
    new = lambda k, s: spark.createDataFrame([(k, s)], "id string, status string")
    assert store.update("m", new(first, "one"), base) == 2
    assert store.update("m", new(other, "two"), base) == 3  # another bucket: on top of the first
    with pytest.raises(Conflict):
        store.update("m", new(same, "three"), base)
    got = {r.id: r.status for r in store.read("m").collect()}
    assert (got[first], got[other], got[same], len(got)) == ("one", "two", "x", 60)
    assert store._publish(3, {}) is False  # a taken version is never overwritten


def test_an_updated_index_equals_a_rebuilt_one(spark, store):
    rng = random.Random(5)
    pool = "alpha alphaBeta beta_x HTTPServer server12 a an and éa 日本 x-y".split()
    doc = lambda i: (f"m{i:03}", rng.choice([None, "", " ".join(rng.choices(pool, k=3))]), rng.choice([None, "", " ".join(rng.choices(pool, k=rng.randrange(30)))]))
    schema = "id string, summary string, details string"
    old = {d[0]: d for d in map(doc, range(60))}
    index.build(store, spark.createDataFrame(list(old.values()), schema), buckets=8)
    changed = [doc(i) for i in (*range(0, 60, 7), 70, 71)]
    gone = ["m001", "m002", "nobody"]
    index.update(store, spark.createDataFrame(changed, schema), spark.createDataFrame([(g,) for g in gone], "id string"))
    now = spark.createDataFrame([d for k, d in (old | {d[0]: d for d in changed}).items() if k not in gone], schema)
    again = adapters.store(spark, "test-rebuilt")
    index.build(again, now, buckets=8)
    for table in (index.BY_ID, index.POSTINGS, index.TERMS, index.STATS):
        assert rows_of(store.read(table).select(*again.read(table).columns)) == rows_of(again.read(table)), table
    queries = spark.createDataFrame([(1, "alpha be"), (2, "server"), (3, "a"), (4, ""), (5, "éa 日"), (6, "nothing")], "request_id long, query string")
    for prefixes in (True, False):
        got = index.search(store, queries, prefixes)
        assert rows_of(got.select("request_id", "id", "score")) == rows_of(hybrid.lexical_scores(now, queries, prefixes).select("request_id", "id", "score"))
    assert index.update(store, spark.createDataFrame([], schema)) == store.head() == 2


def test_a_search_reads_the_index_only(spark, store):
    docs = spark.createDataFrame([(f"m{i}", f"word{i % 50}", "common " * 5) for i in range(200)], "id string, summary string, details string")
    index.build(store, docs, buckets=16)
    found = index.search(store, spark.createDataFrame([(1, "word7")], "request_id long, query string"), prefixes=False)
    files = found.inputFiles()
    assert files and all(store.path.split(":")[-1] in f for f in files)
    assert sum("/postings-" in f for f in files) == 1  # one bucket of sixteen
    assert found.count() == 4


def test_one_very_long_token(spark):
    docs = spark.createDataFrame([("a", "x" * 60_000, "xx y"), ("b", "y", "xx")], "id string, summary string, details string")
    found = hybrid.lexical_scores(docs, spark.createDataFrame([(1, "xx")], "request_id long, query string"))
    assert {r.id for r in found.collect()} == {"a", "b"}


def test_common_and_rare_terms_add_up(spark, store):
    docs = spark.range(60).selectExpr("concat('m', id) id", "concat('all word', id % 7) summary", "concat('all alone', id, ' half', id % 2) details")
    index.build(store, docs, buckets=4)
    queries = spark.createDataFrame([(1, "all half1 alone5"), (2, "a alone word3 nothing"), (3, "none")], "request_id long, query string")
    for prefixes in (True, False):
        got = [sorted(map(tuple, index.search(store, queries, prefixes, common=n).collect())) for n in (0, 3, 9, 10**6)]
        assert got[0] and all(len(g) == len(got[0]) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-6 for a, b in zip(g, got[0])) for g in got)


def test_memories_are_counted_without_an_exchange_of_tokens(spark):
    """Texts are dealt once, and what is exchanged for a term is one row a memory and term, not one a request."""
    docs = spark.range(20).selectExpr("cast(id as string) id", "'a b' summary", "'c d' details")
    plan = index._placed(docs, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    matched = spark.createDataFrame([(1, "t", "s", 2, 1.0), (1, "t", "s", 2, 0.375), (2, "t", "s", 2, 1.0)], "request_id long, term string, f string, df long, weight double")
    rows = index.packed(matched).collect()
    assert len(rows) == 1 and sorted(map(tuple, rows[0].asked)) == [(1, 1.375), (2, 1.0)]


def test_the_best_are_those_of_the_whole_search(spark, store):
    """Words that several queries share are searched once and memories are taken in groups; the result is the search's."""
    docs = spark.range(90).selectExpr("concat('m', lpad(id, 3, '0')) id", "concat('all word', id % 7) summary", "concat('all alone', id, ' half', id % 2, repeat(' half0', cast(id % 5 as int))) details")
    index.build(store, docs, buckets=8)
    index.update(store, docs.where("id < 'm009'").withColumn("summary", F.lit("all other")), docs.where("id > 'm080'").select("id"))
    queries = spark.createDataFrame([(1, "all half1 alone5"), (2, "a alone word3 nothing"), (3, "none"), (4, "all half a")], "request_id long, query string")
    for prefixes in (True, False):
        every = {}
        for r in index.search(store, queries, prefixes).collect():
            every.setdefault(r.request_id, []).append((-r.score, r.id))
        want = sorted((q, i, -s) for q, rows in every.items() for s, i in sorted(rows)[:4])
        for common, groups in ((0, 3), (5, 8), (10**6, 1)):
            got = rows_of(index.best(store, queries, 4, prefixes, save=adapters.stored, common=common, groups=groups).select("request_id", "id", "score"))
            assert [r[:2] for r in got] == [r[:2] for r in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want))


def exchanged(spark, did) -> float:
    """Bytes that the shuffles of ``did`` have written."""

    def written() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        known = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(known.apply(i).totalShuffleWrite() for i in range(known.size()))

    before = written()
    did()
    return written() - before


def test_an_update_exchanges_only_what_is_new(spark, store):
    """Rows that stay are written from where they are; the tables aren't dealt anew."""
    docs = spark.range(3000).selectExpr("concat('m', id) id", "concat('word', id % 50) summary", "array_join(transform(sequence(1, 40), i -> concat('w', (id * 31 + i * 17) % 997)), ' ') details")
    built = exchanged(spark, lambda: index.build(store, docs, buckets=8))
    new = docs.where("id in ('m1', 'm2', 'm3')")
    assert exchanged(spark, lambda: index.update(store, new, docs.where("id = 'm4'").select("id"))) < built / 4


def test_shuffle_files_go_as_tables_are_written(spark, store):
    rows = spark.range(200_000).selectExpr("cast(id as string) id", "id as n")
    blocks = lambda: sum(f.startswith("shuffle_") for _, _, files in os.walk(spark.conf.get("spark.local.dir")) for f in files)
    before = blocks()
    staged = store.stage("t", rows, ("id",), 8, rounds=2)
    until = time.time() + 20  # files go in the background
    while blocks() > before and time.time() < until:
        time.sleep(0.2)
    assert blocks() <= before
    assert sorted(staged.folders) == list(range(8)) and store.staged_rows(staged).count() == 200_000


def test_index_search_asks_every_text_of_benchmark(spark):
    """All texts are asked, not one of twenty; its SQL has no such cut, the other queries' keep theirs."""
    sf = "/root/testdata/sf0.001"
    asked = {r.item_id for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id").collect()}
    got = {r.request_id for r in indexes._queries(spark, sf).collect()}
    assert got == asked and len(asked) == 40
    assert indexes.SOME not in SQL["index_search"] and all(indexes.SOME in SQL[n] for n in ("index_update", "bm25_topk"))
    rows = [r.query_id for r in QUERIES["index_search"](spark, sf).collect()]
    assert len(set(rows)) > 2 and max(rows.count(q) for q in set(rows)) <= 10
