"""Language-model scores by prediction by partial matching over a byte-context trie.

A text is modelled as its A-Z-lower-cased words, each with a space behind it, and one end. The coder sees these bytes after an
opening space; contexts are the up to ``order`` bytes before, across words, and reach back to the text's start.

Training (pretrained mode) counts all training documents. The trie is a table of byte n-grams (gram, n), the last byte coded in
the context of the others: distinct longest grams by task and then by a shuffle, the shorter ones from these. It keeps every
context seen at least ``least`` times, by default all, so it grows with the input; no task, executor or driver holds it.

Coding is PPM with escape method C and symbol exclusion: in the longest known context a symbol has count / (n + d); with d
distinct symbols the escape has d / (n + d), and on the way down symbols already ruled out do not count. Below order 0 all
remaining bytes are equally likely. What follows a context also follows its suffix, so the symbols ruled out are always those
of the next longer context, and a level's sums are one row for each context (``falls``).

Each distinct longest gram of the corpus is coded once. Grams of at least ``common`` of all bytes and words of at least
``frequent`` of all tokens (at most 1 / ``common`` and 1 / ``frequent`` of them) are looked up where documents are read; the
rest, counted by document, are joined by gram and by the hash of the word, of which none can be hot.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, read, text_of

ORDER = 5
SYMBOLS = 256
END = 10  # the end of the text, a byte that no word has
BODY = (1 << 56) - 1


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Documents whose crc32(doc_id as text) mod 7 is 2; a null doc_id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def split(text: str) -> list[bytes]:
    return text.encode().lower().split()


def count_words(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """(word, n): all distinct words of ``docs`` (text, train), n counting those of training texts only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rest = Counter(), set()

        def out() -> pa.RecordBatch:
            rest.difference_update(seen)
            words = [*seen, *rest]
            n = np.concatenate([np.fromiter(seen.values(), np.int64, len(seen)), np.zeros(len(rest), np.int64)])
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n)], ["word", "n"])
            seen.clear()
            rest.clear()
            return batch

        for batch in batches:
            for text, train in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                (seen if train else rest).update(split(text.as_py()))
                if len(seen) + len(rest) > most:
                    yield out()
        yield out()

    return docs.select("text", "train").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def stream(text: str) -> bytes:
    """The coded bytes of a text, after an opening space that is context only."""
    return b" " + b"".join(w + b" " for w in split(text)) + bytes([END])


def longest_grams(streams: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed gram of each coded byte with its up to ``order`` bytes of context (size << 56, then bytes), and coded bytes a text."""
    data = np.frombuffer(b"".join(streams), np.uint8).astype(np.uint64)
    size = np.array([len(x) for x in streams], np.int64)
    depth = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    key = np.minimum(depth, order).astype(np.uint64) + np.uint64(1) << np.uint64(56)
    for k in range(order + 1):
        key[k:] |= np.where(depth[k:] >= k, data[: max(0, len(data) - k)] << np.uint64(8 * k), np.uint64(0))
    return key[depth > 0], size - 1


def count_grams(docs: DataFrame, order: int, block: int = 1 << 22) -> DataFrame:
    """(gram, n, seen): all distinct longest grams of ``docs`` (text, train); n counts training texts only, seen all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, sizes = ([], []), [0, 0]

        def out(train: int) -> pa.RecordBatch:
            keys, counts = np.unique(longest_grams(parts[train], order)[0], return_counts=True)
            parts[train].clear()
            sizes[train] = 0
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts * train), pa.array(counts)], ["gram", "n", "seen"])

        for batch in batches:
            for text, train in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                parts[train].append(stream(text.as_py()))
                sizes[train] += len(parts[train][-1])
                if sizes[train] > block:
                    yield out(int(train))
        for train in (0, 1):
            if parts[train]:
                yield out(train)

    return docs.select("text", "train").mapInArrow(run, "gram long, n long, seen long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def size_of(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, 56).cast("int")


def last(gram: Column, k: Column) -> Column:
    """The gram of the last ``k`` bytes of ``gram``."""
    return gram.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), 8 * k) - 1).bitwiseOR(F.call_function("shiftleft", k.cast("long"), F.lit(56)))


def context_of(gram: Column) -> Column:
    return F.shiftrightunsigned(gram.bitwiseAND(F.lit(BODY)), 8).bitwiseOR(F.shiftleft((size_of(gram) - 1).cast("long"), 56))


def code_grams(found: DataFrame, least: float) -> DataFrame:
    """(gram, seen, p): the log10 probability of each of ``found`` (gram, n, seen), by the trie of those with n."""
    k = F.explode(F.sequence(F.lit(1), size_of(F.col("gram"))))
    grams = found.where("n > 0").select("gram", "n", k.alias("k")).groupBy(last(F.col("gram"), F.col("k")).alias("gram")).agg(F.sum("n").alias("n"))
    grams = grams.withColumn("context", context_of(F.col("gram")))
    if least > 1:
        grams = materialize(grams, "ppm-all")
        grams = grams.join(grams.groupBy("context").agg(F.sum("n").alias("all")).where(F.col("all") >= least).select("context"), "context", "left_semi")
    grams = materialize(grams, "ppm-grams")
    contexts = materialize(grams.groupBy("context").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")), "ppm-contexts")
    shorter = lambda c: last(F.col(c), size_of(F.col(c)) - 1)
    # By context: what its suffix has left when the context's own symbols are ruled out.
    out = grams.where(size_of(F.col("gram")) > 1).select("context", shorter("gram").alias("gram")).join(grams.select("gram", "n"), "gram").groupBy("context").agg(F.sum("n").alias("out"))
    suffix = contexts.select(F.col("context").alias("suffix"), F.col("all").alias("all2"), F.col("kinds").alias("kinds2"))
    falls = contexts.where(size_of(F.col("context")) > 0).withColumn("suffix", shorter("context")).join(out, "context").join(suffix, "suffix")
    falls = materialize(falls.select(F.col("context").alias("longer"), (F.col("kinds2") - F.col("kinds")).alias("left"), (F.col("all2") - F.col("out") + F.col("kinds2") - F.col("kinds")).alias("total")), "ppm-falls")
    sure = grams.join(contexts, "context").select("gram", F.log10(F.col("n") / (F.col("all") + F.col("kinds"))).alias("p"))
    coded = materialize(found.select("gram", "seen").join(sure, "gram", "left"), "ppm-sure")
    # Grams that the trie has not: one row for each length of context.
    new = coded.where("p is null").select("gram", F.explode(F.sequence(F.lit(0), size_of(F.col("gram")) - 1)).alias("k"))
    part = last(F.col("gram"), F.col("k") + 1)
    longer = F.when(F.col("k") + 1 < size_of(F.col("gram")), context_of(last(F.col("gram"), F.least(F.col("k") + 2, size_of(F.col("gram"))))))
    new = materialize(new.select("gram", "k", part.alias("part"), context_of(part).alias("context"), longer.alias("longer")), "ppm-new")

    def levels(rows: DataFrame, small: bool) -> DataFrame:
        # Contexts of at most two bytes are a table of fixed size; each is needed by a share of all rows.
        tables = (contexts, "context", "context", 1), (falls, "longer", "longer", 2), (grams.select(F.col("gram").alias("part"), "n"), "part", "part", 2)
        for table, key, size, most in tables:
            rows = rows.join(F.broadcast(table.where(size_of(F.col(size)) <= most)) if small else table.where(size_of(F.col(size)) > most), key, "left")
        return rows

    rows = levels(new.where("k <= 1"), True).unionByName(levels(new.where("k > 1"), False))
    fell = F.col("total").isNotNull()
    escape = F.when(fell, F.when(F.col("left") > 0, F.log10(F.col("left") / F.col("total"))).otherwise(0.0)).otherwise(F.log10(F.col("kinds") / (F.col("all") + F.col("kinds"))))
    hit = F.log10(F.col("n") / F.when(fell, F.nullif("total", F.lit(0))).otherwise(F.col("all") + F.col("kinds")))
    floor = F.when(F.col("k") == 0, -F.log10(F.greatest(F.lit(1), SYMBOLS - F.coalesce("kinds", F.lit(0)))))
    step = F.struct((-F.col("k")).alias("order"), F.coalesce(escape, F.lit(0.0)).alias("escape"), F.coalesce(hit, floor).alias("hit"), hit.isNull().alias("floor"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("p"))

    def down(state: Column, x: Column) -> Column:
        # A text's symbol is found once; at order 0 the floor comes after that level's escape.
        here = F.when((x["order"] == 0) & x["floor"], state["sum"] + x["escape"] + x["hit"]).otherwise(state["sum"] + x["hit"])
        return F.struct((state["sum"] + x["escape"]).alias("sum"), F.coalesce(state["p"], here).alias("p"))

    folded = rows.groupBy("gram").agg(F.aggregate(F.array_sort(F.collect_list(step)), start, down, lambda x: x["p"]).alias("p2"))
    return coded.join(folded, "gram", "left").select("gram", "seen", F.coalesce("p", "p2").alias("p"))


def score(docs: DataFrame, train_on: Column, order: int = ORDER, least: float = 1.0, frequent: float = 1e-6, common: float = 2.5e-7) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) with a model of those rows for which ``train_on`` holds.

    Returns doc_id, trained (train_on), n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (the model's
    log10 probability). Null and empty texts are one end. Repeated rows stay; a null doc_id stays; a null ``train_on`` is
    false; other columns are ignored; no rows give no rows. Without training rows all bytes are equally likely.
    """
    spark = docs.sparkSession
    held = docs.select("doc_id", text_of().alias("text"), F.coalesce(train_on, F.lit(False)).alias("train"))
    ends = held.where("train").count()
    words = materialize(count_words(held), "ppm-words")
    tokens, kinds = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, kinds = tokens + ends, kinds + (ends > 0)
    counted = materialize(words.select(F.xxhash64("word").alias("wid"), "n"), "ppm-counted")
    coded = materialize(code_grams(materialize(count_grams(held, order), "ppm-found"), least), "ppm-coded")
    bound = max(1.0, frequent * tokens)
    top = counted.where(F.col("n") >= bound).toArrow().sort_by("wid")
    least_seen = max(1.0, common * (coded.agg(F.sum("seen")).first()[0] or 0))
    often = coded.where(F.col("seen") >= least_seen).select("gram", "p").toArrow().sort_by("gram")
    table = spark.sparkContext.broadcast((*(top[c].to_numpy() for c in ("wid", "n")), *(often[c].to_numpy() for c in ("gram", "p"))))
    end_base, end_known = math.log10(ends + 1), int(ends > 0)

    def place(sorted_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_ids, ids), max(0, len(sorted_ids) - 1))
        return at, sorted_ids[at] == ids if len(sorted_ids) else np.zeros(len(ids), bool)

    def lists(doc: np.ndarray, n: int, *columns: np.ndarray) -> list[pa.Array]:
        cuts = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
        return [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in columns]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        ids, counts, grams, ps = table.value
        logs = np.log10(counts + 1.0)
        number = TaskContext.get().partitionId() << 33
        h = xxhash.xxh64_intdigest
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [t.as_py() for t in part.column(1)]
                own = [Counter(split(t)) for t in texts]
                size = np.array([len(c) for c in own], np.int64)
                wid = np.fromiter((h(w, 42) for c in own for w in c), np.uint64, int(size.sum())).view(np.int64)
                tf = np.fromiter((n for c in own for n in c.values()), np.int64, len(wid))
                doc = np.repeat(np.arange(len(own)), size)
                at, hit = place(ids, wid)
                total = lambda w: np.bincount(doc, w, len(own))  # noqa: B023, E731
                n_all = total(tf).astype(np.int64) + 1
                d, t, k = doc[hit], tf[hit], at[hit]
                base = np.bincount(d, t * logs[k], len(own)) + end_base
                known = np.bincount(d, t, len(own)).astype(np.int64) + end_known
                rest = ~hit
                key, coded_bytes = longest_grams([stream(t) for t in texts], order)
                key, of = key.view(np.int64), np.repeat(np.arange(len(own)), coded_bytes)
                at, hit = place(grams, key)
                p = np.bincount(of[hit], ps[at[hit]], len(own)).astype(np.float64)
                key, of = key[~hit], of[~hit]
                o = np.lexsort((key, of))
                key, of = key[o], of[o]
                first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])])) if len(key) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(key)))
                uid = number + np.arange(len(own))
                number += len(own)
                rare = [*lists(doc[rest], len(own), wid[rest], tf[rest]), *lists(of[first], len(own), key[first], times)]
                yield pa.RecordBatch.from_arrays([pa.array(uid), part.column(0).cast(pa.int64()), part.column(2), pa.array(n_all), pa.array(known), pa.array(base), pa.array(p), *rare], fields)

    schema = "uid long, doc_id long, train boolean, n_tokens long, known long, base double, p double, wids array<long>, tfs array<long>, grams array<long>, times array<long>"
    fields = [x.split()[0] for x in schema.split(", ")]
    seen = materialize(held.mapInArrow(look_up, schema), "ppm-docs")
    rare = lambda ids, n: seen.select("uid", F.explode(F.arrays_zip(ids, n)).alias("w")).select("uid", F.col(f"w.{ids}").alias("id"), F.col(f"w.{n}").alias("tf"))
    more = (
        rare("wids", "tfs").join(counted.where(F.col("n") < bound).withColumnRenamed("wid", "id"), "id")
        .groupBy("uid")
        .agg(F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("base2"), F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("known2"))
    )
    spelt = rare("grams", "times").join(coded.where(F.col("seen") < least_seen).withColumnRenamed("gram", "id").hint("merge"), "id").groupBy("uid").agg(F.sum(F.col("tf") * F.col("p")).alias("p2"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        seen.drop("wids", "tfs", "grams", "times")
        .join(materialize(more, "ppm-more"), "uid", "left")
        .join(materialize(spelt, "ppm-spelt"), "uid", "left")
        .select(
            "doc_id",
            F.col("train").alias("trained"),
            "n_tokens",
            (F.col("known") + zero("known2")).alias("n_known"),
            F.lit(tokens).cast("long").alias("train_tokens"),
            (F.col("base") + zero("base2") - F.col("n_tokens") * math.log10(tokens + kinds + 1)).alias("base_score"),
            (F.col("p") + zero("p2")).alias("score"),
        )
    )


def op4_ppm(spark, sf_dir: str) -> DataFrame:
    out = score(read(spark, sf_dir, "documents"), ~held_out())
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
