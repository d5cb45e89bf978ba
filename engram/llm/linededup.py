"""Line dedup by an exact set-similarity join. DataFrame functions only.

A line is the set of its words. It goes if an earlier line (ascending doc_id, then place in the text) has a set with Jaccard
similarity of at least ``near[0] / near[1]``. Lines with the same set are settled by grouping; what is left is joined:

* rarity: the words of the whole corpus are counted in cells by their hash, and a line's words are ordered by the
  class of their cell (twice the binary logarithm of its count), then by hash. Any fixed order gives exact results; this one
  makes the first words rare.
* prefix filter: two similar sets have one of their first floor(n (1 - t)) + 1 words in common. Rows of the join carry these words, so
  two similar sets meet there at least once. The rows carry a size, a place and a sketch, never the prefix itself.
* length and positional filters: sizes must allow the similarity, and so must what follows the common word.
* suffix bound: the words that a pair meets at stand in both prefixes; all other common words stand behind the prefix that
  ends first, so the overlap is at most their number and what is left behind it.
* bitmap filter: each set has a 128-bit parity sketch of its words; where two sketches differ in more bits than similar sets
  could differ in words, the pair is dropped. It never drops a similar pair.
* verification: the Jaccard similarity of the whole lines, read again from the documents. One similar earlier line is enough, so
  the most promising pair of each set is tried first and the others only if it fails.

Groups of many similar lines aren't listed pair by pair. Sets of which at least ``CROWD`` share one of two pairs of neighbouring prefix words, chosen by
hash, first meet hubs: of all such sets that share a pair of neighbouring prefix words the earliest, the most frequent, and some chosen by hash. Sets
that are similar to one of these are settled. Only the others meet all sets with a common prefix word, and only pairs that pass
all filters leave the join. That join is done in ``SLICES`` parts of the words, so its shuffles never hold
more than a part of the prefixes at once, and tables are deleted once nothing reads them.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, discard, fresh, materialize, read, small, text_of

#: Cells of the word counts: a byte each where words are ordered, and at most so many small rows to the driver, at any corpus size.
CELL_BITS = 18
NEAR = (4, 5)
SLICES = 3
#: Sets that share one of so many pairs of neighbouring prefix words with at least CROWD sets meet hubs first.
CROWD, CROWD_PAIRS = 16, 2
#: Pairs of neighbouring prefix words that a set is settled by, and seeds of further hubs of each pair.
HUB_PAIRS, HUB_SEEDS = 6, (1, 2, 3, 4, 5, 6)
#: The mark of settled sets.
SETTLED = 1 << 62
BLANK = " \t\n\v\f\r"


def _odd(text: Column) -> Column:
    return text.contains("\t") | text.contains("\v") | text.contains("\f") | text.contains("\r")


def _spaced(text: Column) -> Column:
    """``text`` with all ASCII white space as spaces, as splitting at one plain character is much cheaper than at a pattern."""
    return F.when(_odd(text), F.translate(text, BLANK[1:], "     ")).otherwise(F.replace(text, F.lit("\n"), F.lit(" ")))


def _cell(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - CELL_BITS).cast("int")


def rarity_classes(docs: DataFrame) -> Column:
    """An array of the class of each cell: twice the binary logarithm of how many words of ``docs`` (text) fell in it."""
    found = docs.select(F.explode(F.split(_spaced(F.col("text")), " ")).alias("w")).where("w <> ''").select(_cell(F.xxhash64("w")).alias("cell")).groupBy("cell")
    table = found.agg(F.least(F.lit(63), F.floor(2 * F.log2(F.count("*") + 1))).cast("int").alias("kind")).toArrow()
    classes = np.zeros(1 << CELL_BITS, np.int8)
    classes[table.column("cell").to_numpy()] = table.column("kind").to_numpy()
    return F.from_json(F.lit(json.dumps(classes.tolist(), separators=(",", ":"))), "array<tinyint>")


def _line_sets(held: DataFrame, near: tuple[int, int]) -> DataFrame:
    """A row for each line with words: its place and its set's id, size, sketch and prefix."""
    num, den = near
    classes = rarity_classes(held)
    lines = held.select("key", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.btrim("line", F.lit(BLANK)) != "")
    found = F.array_distinct(F.transform(F.split(_spaced(F.col("line")), " "), lambda w: F.xxhash64(w)))
    rank = lambda h: F.shiftleft(F.get(classes, _cell(h)).cast("long"), 57).bitwiseOR(h.bitwiseAND(F.lit((1 << 57) - 1)))
    lines = lines.select("key", "row", "line_no", F.sort_array(F.transform(F.array_remove(found, F.xxhash64(F.lit(""))), rank)).alias("tokens"))
    bit = lambda h, k: F.call_function("shiftleft", F.shiftright(h, 6).bitwiseAND(F.lit(1)).bitwiseXOR(F.lit(1 - k)).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    half = lambda k: F.aggregate("tokens", F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(bit(h, k)))  # noqa: E731  words whose bit 6 is k
    n = F.size("tokens")
    return lines.select(
        "key", "row", "line_no", F.xxhash64("tokens").alias("id"), n.alias("n"), half(0).alias("sketch"), half(1).alias("sketch2"),
        F.slice("tokens", F.lit(1), F.floor(n * (den - num) / den).cast("int") + 1).alias("prefix"),
    )


def _unpacked(shape: Column) -> tuple[Column, Column]:
    """A set's size and the prefix word's place, which travel as one number."""
    return F.shiftright(shape, 24), shape.bitwiseAND(F.lit((1 << 24) - 1))


def _differ(a: str, b: str) -> Column:
    """The bits in which two sets' sketches differ, of which there are no more than words."""
    return F.bit_count(F.col(f"{a}.sketch").bitwiseXOR(F.col(f"{b}.sketch"))) + F.bit_count(F.col(f"{a}.sketch2").bitwiseXOR(F.col(f"{b}.sketch2")))


def _alike(a: str, b: str, n: Column, m: Column, near: tuple[int, int]) -> Column:
    """Whether the sizes and sketches of two sets allow the similarity, ``b`` being in no later document."""
    num, den = near
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    differ = _differ(a, b)
    size = (F.least(n, m) * den >= F.greatest(n, m) * num) & (differ * (num + den) <= (n + m) * (den - num))
    return (x("word") == y("word")) & (x("id") != y("id")) & (y("key") <= x("key")) & size


def _meetings(group: DataFrame, near: tuple[int, int]) -> DataFrame:
    """(later, earlier, differ, least) of the pairs that share a prefix word of ``group`` and pass the filters, a row for each such word. Similar pairs have ``least`` rows or more.

    The mark of a settled set stays in its size as the later one, so it fails the length filter. (A filter of that side alone
    would go below the exchange, and both sides would be shuffled instead of one.)
    """
    num, den = near
    (n, at), (m, to) = _unpacked(F.col("a.shape")), _unpacked(F.col("b.shape").bitwiseAND(F.lit(SETTLED - 1)))
    most = F.least(at, to) + F.least(n - at, m - to)  # common words, at most
    on = _alike("a", "b", n, m, near) & (most * (num + den) >= (n + m) * num)
    both = group.alias("a").join(group.alias("b").hint("merge"), on)
    behind = lambda c: c - F.floor(c * (den - num) / den) - 1  # noqa: E731  words behind the prefix
    least = F.ceil((n + m) * num / (num + den)) - F.greatest(behind(n), behind(m))
    return both.select(F.col("a.id").alias("later"), F.col("b.id").alias("earlier"), _differ("a", "b").alias("differ"), least.alias("least"))


def _texts(held: DataFrame, sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, place, line) of the sets ``ids``, read from the documents that have them first."""
    places = sets.join(ids.distinct(), "id").groupBy("key", "row").agg(F.collect_list(F.struct("id", "line_no")).alias("places"))
    cut = F.split("text", "\n")
    lines = F.transform("places", lambda p: F.struct(p["id"].alias("id"), p["line_no"].alias("line_no"), F.get(F.col("cut"), p["line_no"]).alias("line")))
    found = held.drop("key").join(places, "row").select("key", "row", "places", cut.alias("cut")).select("key", "row", F.explode(lines).alias("p"))
    # Rows that are equal give the same line several times.
    return materialize(found.select("p.id", F.struct("key", "row", "p.line_no").alias("place"), "p.line").dropDuplicates(["id"]), "line-texts")


def _verified(texts: DataFrame, pairs: DataFrame, near: tuple[int, int]) -> DataFrame:
    """(id) of the later sets of ``pairs`` (later, earlier) whose lines are similar."""
    num, den = near
    both = pairs.join(texts.select(F.col("id").alias("later"), F.col("place").alias("at"), F.col("line").alias("a")), "later")
    both = both.join(texts.select(F.col("id").alias("earlier"), F.col("place").alias("before"), F.col("line").alias("b")), "earlier").where("before < at")
    parts = lambda c: F.array_distinct(F.array_remove(F.split(_spaced(F.col(c)), " "), "")).alias(c)  # noqa: E731  lines travel as text, which is narrower
    both = both.select("later", parts("a"), parts("b"))
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common * (num + den) >= (F.size("a") + F.size("b")) * num).select(F.col("later").alias("id")).distinct()


def _pairs(a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
    """(later, earlier, differ) of the rows of ``a`` and ``b`` that may be similar; the sketches differ in ``differ`` bits."""
    differ = _differ("a", "b").alias("differ")
    return a.alias("a").join(b.alias("b").hint("merge"), on).select(F.col("a.id").alias("later"), F.col("b.id").alias("earlier"), differ).distinct()


def _settled(held: DataFrame, sets: DataFrame, pairs: DataFrame, near: tuple[int, int]) -> DataFrame:
    """(id) of the later sets of the table ``pairs`` for which one of the pairs is similar. ``pairs`` is used up."""
    best = pairs.groupBy("later").agg(F.min(F.struct("differ", "earlier")).alias("best"), F.count("*").alias("all"))
    best = materialize(best.select("later", F.col("best.earlier").alias("earlier"), "all"), "line-best")
    texts = _texts(held, sets, pairs.select(F.col("later").alias("id")).unionByName(pairs.select(F.col("earlier").alias("id"))))
    found = materialize(_verified(texts, best.select("later", "earlier"), near), "line-found")
    left = best.where(F.col("all") > 1).join(found.withColumnRenamed("id", "later"), "later", "left_anti").select("later", F.col("earlier").alias("tried"))
    others = pairs.join(left, "later").where("earlier != tried").select("later", "earlier")
    more = materialize(_verified(texts, others, near), "line-found")
    discard(pairs, best, texts)
    return found.unionByName(more)


def _neighbours(keys: int) -> Column:
    """A row for each of the ``keys`` pairs of neighbouring prefix words that have the least hashes."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("prefix") - 1, F.lit(1))), lambda i: F.xxhash64(F.slice("prefix", i, 2)))
    return F.explode(F.slice(F.sort_array(F.array_distinct(pairs)), 1, keys)).alias("word")


def _crowded(able: DataFrame) -> DataFrame:
    """The sets that share one of ``CROWD_PAIRS`` pairs of neighbouring prefix words with at least ``CROWD`` sets, themselves included."""
    held = materialize(able.select("id", _neighbours(CROWD_PAIRS)), "line-neighbours")
    words = held.groupBy("word").count().where(F.col("count") >= CROWD).select("word")
    ids = materialize(held.join(words, "word", "left_semi").select("id").distinct(), "line-crowd")
    found = able.join(small(ids), "id", "left_semi")
    found = materialize(found.select("id", "n", "sketch", "sketch2", "key", "times", _neighbours(HUB_PAIRS)), "line-crowded")
    discard(held, ids)
    return found


def _hub_pairs(own: DataFrame, near: tuple[int, int]) -> DataFrame:
    """Pairs of the sets ``own`` (a row for each of their pairs of neighbouring words) with hubs: of all that share such a pair, the earliest, the most frequent, and one for each seed."""
    fields = ("key", "id", "n", "sketch", "sketch2")
    some = [F.min(F.struct(*fields)).alias("hub0"), F.max(F.struct("times", (-F.col("key")).alias("least"), *fields)).alias("hub1")]
    some += [F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("rank"), *fields)).alias(f"hub{k + 1}") for k in HUB_SEEDS]
    hubs = own.groupBy("word").agg(F.count("*").alias("rows"), *some).where("rows > 1")
    each = F.array_distinct(F.array(*(F.struct(*(F.col(f"hub{k}.{c}").alias(c) for c in fields)) for k in range(2 + len(HUB_SEEDS)))))
    hubs = hubs.select("word", F.explode(each).alias("hub")).select("word", "hub.*")
    return materialize(_pairs(own, hubs, _alike("a", "b", F.col("a.n"), F.col("b.n"), near)), "line-pairs")


def matched_sets(held: DataFrame, sets: DataFrame, near: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(id) of the sets to which an earlier, different one is similar, and ``sets`` without prefixes. ``sets`` is used up."""
    num, den = near
    able = sets.where(F.col("n") * num >= (den - num) * den - den + num + 1)
    places = materialize(sets.select("id", "times", "key", "row", "line_no"), "line-places")
    crowded = _crowded(able)
    settled = _settled(held, places, _hub_pairs(crowded, near), near)
    discard(crowded)
    mark = F.when(F.col("done"), F.lit(SETTLED)).otherwise(F.lit(0))
    rest = able.join(settled.withColumn("done", F.lit(True)), "id", "left")
    rest = materialize(rest.select("id", "sketch", "sketch2", "key", "prefix", (F.shiftleft(F.col("n").cast("long"), 24) + mark).alias("shape")), "line-prefixes")
    discard(sets)
    second = []
    for part in range(SLICES):
        group = rest.select("id", "sketch", "sketch2", "key", "shape", F.posexplode("prefix").alias("at", "word")).where(F.pmod("word", F.lit(SLICES)) == part)
        group = group.select("word", "id", "sketch", "sketch2", "key", (F.col("shape") + F.col("at")).alias("shape"))
        second.append(materialize(_meetings(group, near), "line-meetings"))
    discard(rest)
    met = reduce(DataFrame.unionByName, second).groupBy("later", "earlier").agg(F.min("differ").alias("differ"), F.min("least").alias("least"), F.count("*").alias("words"))
    listed = materialize(met.where("words >= least").drop("least", "words"), "line-pairs")
    discard(*second)
    return settled.unionByName(_settled(held, places, listed, near)), places


def dedup_lines(docs: DataFrame, near: tuple[int, int] = NEAR) -> DataFrame:
    """Every row of ``docs`` without the lines to which an earlier line is similar.

    Returns the columns of ``docs`` (doc_id, text and any others but those named next) with ``text`` cut, then ``n_lines``
    (lines with words) and ``n_removed``. Lines are judged on the input: a line that goes still counts as the earlier one for
    others. Lines without words stay. Null texts stay null and have no lines. A null doc_id comes first; rows with the
    same doc_id are ordered by a hash of their text; rows equal in both are one document and get the same result. No rows give
    no rows. ``near``: the least similarity as a fraction.
    """
    row, removed_lines = fresh(docs, "row", "removed_lines")
    held = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), F.xxhash64("doc_id", text_of()).alias("row"), text_of().alias("text"))
    wide = materialize(_line_sets(held, near), "lines")
    kept = ("n", "sketch", "sketch2", "prefix")
    sets = wide.groupBy("id").agg(F.count("*").alias("times"), F.min(F.struct("key", "row", "line_no")).alias("place"), *(F.first(c).alias(c) for c in kept))
    sets = materialize(sets.select("id", "times", "place.*", *kept), "line-sets")
    lines = materialize(wide.select("id", "row", "line_no"), "line-ids")
    discard(wide)
    matched, sets = matched_sets(held, sets, near)
    judged = sets.select("id", "times", F.col("row").alias("row0"), F.col("line_no").alias("line0")).join(matched.withColumn("gone", F.lit(True)), "id", "left")
    judged = judged.where("times > 1 or gone").select("id", "row0", "line0", F.coalesce("gone", F.lit(False)).alias("gone"))
    removed = lines.select("id", "row", "line_no").join(judged, "id").where("gone or row != row0 or line_no != line0")
    removed = materialize(removed.groupBy("row").agg(F.collect_set("line_no").alias(removed_lines)).withColumnRenamed("row", row), "line-removed")
    discard(lines, sets, matched)
    solid = F.when(_odd(text_of()), F.translate(text_of(), BLANK.replace("\n", ""), "")).otherwise(F.replace(text_of(), F.lit(" "), F.lit("")))
    counted = F.size(F.array_remove(F.split(solid, "\n"), "")).cast("long")
    other = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    full = docs.select(*columns_of(other), F.xxhash64("doc_id", text_of()).alias(row)).join(removed, row, "left")
    gone = F.col(removed_lines)
    cut = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(1), F.size(cut)), F.transform(gone, lambda i: i + 1))
    text = F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.element_at(cut, i)), "\n"))
    full = full.withColumn("n_lines", counted).withColumn("n_removed", F.coalesce(F.size(gone), F.lit(0)).cast("long"))
    return full.withColumn("text", text).select(*columns_of(other), "n_lines", "n_removed")


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(text_of(), 256).alias("kept_sha256"))


#: The same rows by DuckDB. Pairs of different sets are found by their rarest words (exact document frequencies here).
OP10_SQL = r"""
with line as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as line_no from documents
), word as (
    select *, list_sort(list_distinct(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) as words from line
), held as (select * from word where len(words) > 0),
sets as (
    select words, len(words) as n, min(struct_pack(d := doc_id, l := line_no)) as first, row_number() over (order by words) as id from held group by words
), token as (select id, n, first, unnest(words) as w from sets),
ranked as (
    select t.*, row_number() over (partition by id order by df, t.w) as place from token t join (select w, count(*) as df from token group by w) using (w)
), prefix as (select * from ranked where place <= floor(n / 5.0) + 1),
pair as (
    select distinct a.id as later, b.id as earlier from prefix a join prefix b on a.w = b.w and a.id <> b.id and b.first < a.first and least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4
), gone as (
    select distinct p.later as id from pair p join sets a on a.id = p.later join sets b on b.id = p.earlier
    where len(list_intersect(a.words, b.words)) * 9 >= (a.n + b.n) * 4
), judged as (
    select h.doc_id, h.line_no, (g.id is not null or struct_pack(d := h.doc_id, l := h.line_no) <> s.first) as removed
    from held h join sets s using (words) left join gone g on g.id = s.id
)
select w.doc_id, count(*) filter (len(w.words) > 0) as n_lines, count(*) filter (coalesce(j.removed, false)) as n_removed,
    sha256(coalesce(string_agg(w.line, chr(10) order by w.line_no) filter (not coalesce(j.removed, false)), '')) as kept_sha256
from word w left join judged j on j.doc_id = w.doc_id and j.line_no = w.line_no
group by w.doc_id
"""
