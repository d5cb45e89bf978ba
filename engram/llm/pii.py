"""Personal data: pattern spans, and terms that disclose the protected values behind them. DataFrame functions only.

Base spans come from four patterns. Long strings of letters and digits are protected as well, as secrets. A protected entity is
a distinct value, or its class: the domain of an email, the network of an ip, the issuer of a card, the area of a phone number,
all secrets together. From the whole corpus we estimate how strongly a term reveals an entity it stands beside, in distinct
texts and with one virtual text that follows the corpus (so a term seen once proves little):

    P(entity | term) = (texts with the term beside the entity + P(entity)) / (texts with the term anywhere + 1)
    gain             = log2(P(entity | term) / P(entity)), in bits

A term that has both over their thresholds, in at least ``support`` different surroundings, gives the entity away even after
the entity itself is masked, and wherever else it stands. So all its occurrences in all documents become spans:
``generalise`` (replaced by a placeholder), or ``remove`` if the entity nearly follows from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, fresh, materialize, read, small, text_of

KINDS = ("email", "ip", "card", "phone")
#: The patterns, fixed by contract. A match starts where a run starts or the last match ended, which is what a search from
#: every place finds too, without its quadratic time on long runs.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"[\p{L}\p{N}]{3,}"
#: A secret: a long string that has both letters and digits.
SECRET = r"(?:(?<![A-Za-z0-9_-])|\G)[A-Za-z0-9_-]{32,}+"


def spans_of(text: Column, pattern: str | Column) -> Column:
    """All matches of ``pattern``: array of (start, end, value), in code points from 0."""
    found = F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(F.length(g).alias("gap"), m.alias("value")))
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,value:string>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])


def luhn(digits: Column) -> Column:
    def value(x: Column, i: Column) -> Column:
        v = x.cast("int") * (1 + i % 2)
        return F.when(v > 9, v - 9).otherwise(v)

    each = F.transform(F.array_remove(F.split(F.reverse(digits), ""), ""), value)
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def accepted(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        bare = lambda p: F.ltrim(p, F.lit("0"))
        small = lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(F.substring(bare(p), 1, 3).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array of (start, rank, kind, end, value), sorted; ``rank`` is the kind's place in ``KINDS``."""
    def part(rank: int, kind: str) -> Column:
        found = F.filter(spans_of(text, PATTERNS[kind]), lambda s: accepted(kind, s["value"]))
        rows = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
        some = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        if kind != "email":
            some = some & text.rlike("[0-9]")
        return F.when(some, rows).otherwise(F.from_json(F.lit("[]"), "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"))

    parts = [part(rank, kind) for rank, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*parts))


def secret_spans(text: Column, base: Column) -> Column:
    """array of (start, kind, end, value) of the secrets that no base span overlaps, sorted."""
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    clear = lambda t: ~F.exists(base, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    found = F.filter(spans_of(text, SECRET), lambda s: mixed(s["value"]) & clear(s))
    rows = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit("secret").alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return F.when(text.rlike("[A-Za-z0-9_-]{32}"), rows).otherwise(F.from_json(F.lit("[]"), "array<struct<start:int,kind:string,end:int,value:string>>"))


def entities_of(kind: Column, value: Column) -> Column:
    """Names of the entities that a protected value stands for: itself, and its class."""
    v = F.lower(value)
    digits = F.regexp_replace(v, "[^0-9]", "")
    group = (
        F.when(kind == "email", F.substring_index(v, "@", -1))
        .when(kind == "ip", F.substring_index(v, ".", 2))
        .when(kind == "card", F.substring(digits, 1, 6))
        .when(kind == "phone", F.substring(digits, 1, 4))
        .otherwise("")
    )
    return F.array(F.xxhash64(kind, v), F.xxhash64(kind, group, F.lit("class")))


def context_terms(text: Column, spans: Column, chars: int) -> Column:
    """Terms within ``chars`` code points of a protected span, none cut by that limit, in none of them: array of (entity, term, window)."""
    clear = lambda a, b: ~F.exists(spans, lambda s: (s["start"] < b) & (a < s["end"]))

    def beside(s: Column) -> Column:
        left = F.greatest(s["start"] - chars, F.lit(0))
        start, end = F.substring(text, left + 1, s["start"] - left), F.substring(text, s["end"] + 1, F.lit(chars))
        before = F.filter(spans_of(start, TERM), lambda t: ((t["start"] > 0) | (left == 0)) & clear(t["start"] + left, t["end"] + left))
        after = F.filter(spans_of(end, TERM), lambda t: (t["end"] < chars) & clear(t["start"] + s["end"], t["end"] + s["end"]))
        terms = F.array_distinct(F.transform(F.concat(before, after), lambda t: F.lower(t["value"])))
        window = F.xxhash64(F.lower(start), F.lower(end))
        pair = lambda e: F.transform(terms, lambda t: F.struct(e.alias("entity"), t.alias("term"), window.alias("window")))
        return F.flatten(F.transform(entities_of(s["kind"], s["value"]), pair))

    return F.flatten(F.transform(spans, beside))


def occurrences(text: Column, flagged: Column) -> Column:
    """Where the terms of ``flagged`` (array of term, kind) stand in ``text`` as whole terms: array of (start, kind, end)."""
    pattern = lambda t: F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), t, F.lit(r"(?![\p{L}\p{N}])"))  # noqa: E731  terms are letters and digits
    each = lambda f: F.transform(spans_of(text, pattern(f["term"])), lambda s: F.struct(s["start"].alias("start"), f["kind"].alias("kind"), s["end"].alias("end")))
    return F.flatten(F.transform(flagged, each))


def disclosing(beside: DataFrame, protected: DataFrame, held: DataFrame, support: int, reveal: float, remove: float, gain: float) -> DataFrame:
    """(term, kind) of the terms over the thresholds, and their share, gain and counts for the entity they reveal most."""
    texts = held.groupBy("text_key").agg(F.first("text").alias("text"))  # copies say nothing about how common a term is
    pairs = beside.groupBy("entity", "term", "text_key").agg(F.min("window").alias("window")).groupBy("entity", "term")
    pairs = pairs.agg(F.count("*").alias("n_both"), F.count_distinct("window").alias("windows")).where(F.col("windows") >= support)
    entities = protected.distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    letters = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    known = texts.select(F.explode(letters).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    wanted = materialize(pairs, "pii-pairs")
    total = held.select("text_key").distinct().agg(F.count(F.lit(1)).alias("n_all"))
    prior = F.col("n_entity") / F.col("n_all")
    scored = wanted.join(entities, "entity").join(known, "term").crossJoin(F.broadcast(total))  # one row
    scored = scored.withColumn("share", (F.least("n_both", "n_term") + prior) / (F.col("n_term") + 1)).withColumn("gain", F.log2(F.col("share") / prior))
    scored = scored.where((F.col("share") >= reveal) & (F.col("gain") >= gain))
    best = scored.groupBy("term").agg(F.max(F.struct("share", "gain", "n_both", "n_term", "n_entity")).alias("best"))
    kind = F.when(F.col("best.share") >= remove, F.lit("remove")).otherwise(F.lit("generalise"))
    return materialize(best.select("term", kind.alias("kind"), "best.*"), "pii-terms")


SPANS = "array<struct<start:int,kind:string,end:int>>"


def find(docs: DataFrame, chars: int = 40, support: int = 3, reveal: float = 0.5, remove: float = 0.9, gain: float = 6.0) -> DataFrame:
    """``docs`` ids with their spans: doc_id, row_key, base (array), added (array of start, kind, end; secret, generalise or remove).

    Null texts are empty and have no spans. All rows stay and equal texts get equal spans; in the statistics, which cover all
    documents, equal texts count once. A null doc_id stays. Other columns are ignored. No rows give no rows.
    """
    held = docs.select("doc_id", text_of().alias("text")).withColumn("text_key", F.xxhash64("text"))
    based = held.withColumn("base", base_spans(F.col("text")))
    based = based.withColumn("secrets", secret_spans(F.col("text"), F.col("base")))
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))
    spans = F.concat(F.transform("base", plain), F.col("secrets"))
    near = F.when(F.size(spans) > 0, context_terms(F.col("text"), spans, chars)).otherwise(F.from_json(F.lit("[]"), "array<struct<entity:bigint,term:string,window:bigint>>"))
    own = F.flatten(F.transform(spans, lambda s: entities_of(s["kind"], s["value"])))
    row_key = F.xxhash64("doc_id", "text").alias("row_key")
    based = materialize(based.select("doc_id", row_key, "text_key", "base", F.transform("secrets", lambda s: s.dropFields("value")).alias("hidden"), near.alias("near"), own.alias("own")), "pii-base")
    beside = based.where(F.size("near") > 0).select("text_key", F.explode("near").alias("n")).select("text_key", "n.entity", "n.term", "n.window")
    protected = based.where(F.size("own") > 0).select("text_key", F.explode("own").alias("entity"))
    flagged = disclosing(beside, protected, held, support, reveal, remove, gain).select("term", "kind")
    # Documents with flagged terms anywhere, then where in them.
    letters = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    having = held.select("text_key", F.explode(letters).alias("term")).join(small(flagged), "term")
    having = materialize(having.groupBy("text_key").agg(F.array_sort(F.collect_set(F.struct("term", "kind"))).alias("flagged")), "pii-having")
    found = held.select("text_key", "text").join(small(having), "text_key").select("text_key", occurrences(F.col("text"), F.col("flagged")).alias("terms"))
    found = materialize(found.dropDuplicates(["text_key"]), "pii-found")
    clear = lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    apart = lambda t: clear(t) & ~F.exists("hidden", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    added = F.array_sort(F.concat("hidden", F.filter(F.coalesce("terms", F.from_json(F.lit("[]"), SPANS)), apart)))
    return based.join(found, "text_key", "left").select("doc_id", "row_key", "base", added.alias("added"))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with spans (array of start, kind, end; sorted) replaced by ``[kind]``, those of kind remove taken out."""

    def step(state: Column, s: Column) -> Column:
        mask = F.when(s["kind"] == "remove", F.lit("")).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        new = F.struct(s["end"].alias("at"), F.concat(state["out"], gap, mask).alias("out"))
        return F.when(s["start"] < state["at"], F.struct(F.greatest(s["end"], state["at"]).alias("at"), state["out"].alias("out"))).otherwise(new)

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with all spans of ``find`` masked in ``text``. Null texts become empty; all rows and other columns stay."""
    key, found = fresh(docs, "row_key", "found_spans")
    both = F.array_sort(F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))), "added"))
    spans = find(docs, **thresholds).dropDuplicates(["row_key"]).select(F.col("row_key").alias(key), both.alias(found))
    held = docs.withColumn(key, F.xxhash64("doc_id", text_of()))
    return held.join(spans, key).withColumn("text", redact(text_of(), F.col(found))).select(*columns_of(docs.columns))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    found = find(read(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    both = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))),
        F.transform("added", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))),
    )
    return found.select(
        "doc_id",
        *map(number, KINDS),
        F.sha2(F.array_join(F.transform("base", line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(F.array_sort(both), line), ",").alias("spans"),
    )
