"""I-Match document fingerprints from randomised lexicon subsets, with DataFrame functions only.

The lexicon is every term (lower-cased word, by its 64-bit hash) whose document frequency over distinct texts lies in a band, so very common and
very rare terms are left out. As the document frequencies sum to the distinct terms of all documents, the lexicon has at most
(mean distinct terms of a document) / ``low`` entries at any corpus size; it travels as one array.

A fingerprint has one slot for each randomised subset of the lexicon: the hash of the document's sorted distinct terms in the
subset, or ``-`` for none; a text with words but no filled slot has the hash of all its terms in the first. Subsets keep a term by a seeded hash, at several rates, so short and long documents both have
slots of a few terms. The likeness of two fingerprints is the share of equal slots among those that either fills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, read, text_of, words

#: (rate, subsets): each of so many subsets keeps one lexicon term in ``rate``.
SUBSETS = ((8, 4), (64, 8), (256, 20))


def term_hashes(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, low: float = 0.005, high: float = 0.1) -> DataFrame:
    """Terms of ``docs`` whose document frequency is in [low, high] of all distinct texts and at least 2: one row, one array."""
    text = text_of()
    # Copies say nothing about how common a term is. Each word goes through the exchange once a text, not as often as the text has it.
    docs = docs.groupBy(F.xxhash64(text)).agg(F.first(F.array_join(F.array_sort(F.array_distinct(words(F.lower(text)))), " ")).alias("text"))
    found = docs.select(F.explode(F.array_distinct(term_hashes(text_of()))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    kept = found.crossJoin(F.broadcast(total)).where((F.col("df") >= 2) & (F.col("df") >= F.col("n") * low) & (F.col("df") <= F.col("n") * high))
    return kept.agg(F.array_sort(F.collect_list("term")).alias("terms"))


def slots(terms: Column) -> Column:
    """Fingerprint slots of a sorted array of distinct lexicon terms."""
    def part(rate: int, k: int) -> Column:
        return F.filter(terms, lambda t: F.pmod(F.xxhash64(t, F.lit(rate * 1000 + k)), F.lit(rate)) == 0)

    out = [part(rate, k) for rate, subsets in SUBSETS for k in range(subsets)]
    return F.transform(F.array(*out), lambda p: F.when(F.size(p) == 0, F.lit("-")).otherwise(F.lower(F.hex(F.xxhash64(p)))))


def filled(terms: Column, every: Column) -> Column:
    """``slots`` of the lexicon terms; if none is filled, the first has the hash of the sorted distinct terms of ``every``."""
    whole = F.concat(F.array(F.lower(F.hex(F.xxhash64(F.array_sort(F.array_distinct(every)))))), F.array_repeat(F.lit("-"), sum(n for _, n in SUBSETS) - 1))
    return F.transform(F.array(slots(terms)), lambda s: F.when(F.exists(s, lambda x: x != "-") | (F.size(every) == 0), s).otherwise(whole))[0]


def likeness(a: Column, b: Column) -> Column:
    """Equal filled slots over filled slots; two fingerprints without any filled slot, of wordless texts, are alike (1)."""
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != "-") | (y != "-")), lambda x: x))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != "-") & (x == y)), lambda x: x))
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used)


def fingerprints(docs: DataFrame, terms: Column | None = None) -> DataFrame:
    """``docs`` with a column ``fingerprint`` (slots joined by a dot).

    Null texts count as empty; only texts without words have no filled slot. Equal texts have equal fingerprints. Other columns stay,
    but for one called ``fingerprint``; rows are neither merged nor lost, whatever their ids; no rows give no rows.
    """
    terms = lexicon(docs).scalar() if terms is None else terms
    (own,) = fresh(docs, "lexicon_terms")
    rows = docs.withColumn(own, F.array_intersect(terms, term_hashes(text_of())))
    return rows.withColumn("fingerprint", F.array_join(filled(F.col(own), term_hashes(text_of())), ".")).drop(own)


def with_next(docs: DataFrame, rows_per_range: int = 64, max_ranges: int = 4096) -> DataFrame:
    """(key, at, rank, text, next_text, real): each row with the text of the next in ascending doc_id, the last with the first's.

    Ids are cut into ranges at quantiles that are ids themselves, and the first row of a range is also put at the end of
    the range before (``real`` false), so every row finds its successor in its own range and the text is shuffled once. A
    null doc_id comes first; equal ids are ordered by text.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    rows, first, n = docs.agg(F.count(F.lit(1)), F.min(key), F.lit(0)).first()
    count = max(1, min(max_ranges, rows // rows_per_range))
    shares = [k / count for k in range(1, count)]
    cuts = sorted({*(docs.agg(F.percentile_approx(key, shares, 100 * count)).first()[0] if shares and rows else []), *([first] if rows else [])})
    coarse = max(1, int(len(cuts) ** 0.5))
    array = lambda xs: F.from_json(F.lit("[" + ",".join(map(str, xs)) + "]"), "array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda c: c <= F.col("_key")))
    held = docs.select("doc_id", text_of().alias("text"), key.alias("_key"))
    block = F.greatest(below(array(cuts[::coarse])) - 1, F.lit(0))
    held = held.withColumn("_block", block)
    at = F.col("_block") * coarse + below(F.slice(array(cuts), F.col("_block") * coarse + 1, F.lit(coarse)))
    held = held.withColumn("at", at)
    is_cut = F.array_contains(F.slice(array(cuts), F.col("_block") * coarse + 1, F.lit(coarse)), F.col("_key"))
    before = F.when(F.col("_key") == F.lit(first if rows else 0), F.lit(len(cuts))).otherwise(F.col("at") - 1)
    places = F.when(is_cut, F.array(F.struct(F.col("at").alias("at"), F.lit(True).alias("real")), F.struct(before.alias("at"), F.lit(False).alias("real")))).otherwise(
        F.array(F.struct(F.col("at").alias("at"), F.lit(True).alias("real")))
    )
    out = held.select("doc_id", "text", "_key", F.explode(places).alias("p")).select("doc_id", "text", "_key", "p.at", "p.real")
    order = Window.partitionBy("at").orderBy(F.desc("real"), "_key", "text")
    return out.withColumn("next_text", F.lead("text").over(order))


def op5_imatch(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    terms = lexicon(docs).scalar()
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)))
    rows = rows.withColumn("own", F.array_intersect(terms, term_hashes(F.col("text")))).withColumn("other", F.array_intersect(terms, term_hashes(F.col("edited"))))
    rows = rows.select("doc_id", "at", "real", "_key", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), filled(F.col("own"), term_hashes(F.col("text"))).alias("own"), filled(F.col("other"), term_hashes(F.col("edited"))).alias("other"))
    order = Window.partitionBy("at").orderBy(F.desc("real"), "_key", "text")
    rows = rows.withColumn("next", F.lead("own").over(order)).where("real")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.array_join("own", ".").alias("fingerprint"),
        F.array_join("other", ".").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
