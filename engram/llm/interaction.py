"""How filters interact: what each removes in every order, and its Shapley share.

A document is the set of filters that it fails, a bit mask. Spark counts documents by part and mask, so at most 2^k cells a part are
left at any corpus size. For each part the k! orders are visited by transpositions of neighbours (each order differs from the one before in
two adjacent places): only the two steps that change places are summed anew from the cells, all others keep their figures. What each
filter removes is added up along the walk; that sum is its Shapley value times k!.

Texts that occur before are found without joining texts: within one text all rows fail the same other filters, so copies are
first counted by (text, doc_id) and then by text, and only counts move. A text is known by its SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import masked, read, text_of, words

MOST_FILTERS = 7
STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def swaps(k: int) -> Iterator[int]:
    """Places j whose filters j and j + 1 change, one after another: each of the k! orders is visited once."""
    way, order = [-1] * k, list(range(k))
    while True:
        # The largest filter that can move past a smaller one moves; larger ones turn round.
        able = [v for v in range(k) if 0 <= (at := order.index(v)) + way[v] < k and order[at + way[v]] < v]
        if not able:
            return
        v = max(able)
        at = order.index(v)
        to = at + way[v]
        order[at], order[to] = order[to], order[at]
        for u in range(v + 1, k):
            way[u] = -way[u]
        yield min(at, to)


def walk(part: str, cells: dict[int, tuple[int, int, int]], names: str) -> list[tuple]:
    """Rows of ``STEPS`` for one part: every order of the filters ``names`` and every place in it. Cells: mask -> (n, good, toxic)."""
    k = len(names)

    def step(before: int, f: int) -> tuple[int, ...]:
        """What filter ``f`` does after the filters ``before``: kept, removed, redundant, good and toxic removed."""
        kept = removed = redundant = good = toxic = 0
        for mask, (n, g, t) in cells.items():
            if mask & before:
                redundant += n if mask >> f & 1 else 0
            elif mask >> f & 1:
                removed, good, toxic = removed + n, good + g, toxic + t
            else:
                kept += n
        return kept, removed, redundant, good, toxic

    order = list(range(k))
    before = [(1 << j) - 1 for j in range(k)]
    steps = [step(before[j], order[j]) for j in range(k)]
    total, seen = [0] * k, []

    def visit() -> None:
        seen.append(("".join(names[f] for f in order), order.copy(), steps.copy()))
        for j, f in enumerate(order):
            total[f] += steps[j][1]

    visit()
    for j in swaps(k):
        order[j], order[j + 1] = order[j + 1], order[j]
        before[j + 1] = before[j] | 1 << order[j]
        steps[j], steps[j + 1] = step(before[j], order[j]), step(before[j + 1], order[j + 1])
        visit()
    alone = [cells.get(1 << f, (0,))[0] for f in range(k)]
    return [
        (part, name, j + 1, kept, removed, redundant, alone[f], good, toxic, total[f])
        for name, fs, done in seen
        for j, (f, (kept, removed, redundant, good, toxic)) in enumerate(zip(fs, done, strict=True))
    ]


def cells(docs: DataFrame, labels: DataFrame, conditions: dict[str, str], repeats: str) -> DataFrame:
    """(part, mask, n, good, toxic) of ``docs`` (doc_id, text, source) by the filters they fail, in the order of the letters.

    ``conditions``: letter -> SQL condition of the texts that fail, over text and ws (its words). ``repeats`` is the letter of the filter
    that a text fails if a smaller doc_id has it.
    """
    names = sorted({*conditions, repeats})
    bit = {f: 1 << i for i, f in enumerate(names)}
    held = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text_of().alias("text")).select("*", words(F.col("text")).alias("ws"))
    mask = sum((F.when(F.expr(c), bit[f]).otherwise(0) for f, c in conditions.items()), F.lit(0))
    rows = held.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("name"))
    rows = rows.groupBy("name", "doc_id", "part", "mask").agg(F.count("*").alias("n"))  # keys hold ids, so copies don't meet in one task
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce("quality", F.lit(0))).alias("good"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    flag = lambda c: F.coalesce(F.col(c) == 1, F.lit(False)).alias(c)
    # Rows without an id have no label; kept out of the join, they don't gather in one task.
    marked = rows.where("doc_id is not null").join(known, "doc_id", "left").select("name", "doc_id", "part", "mask", "n", flag("good"), flag("toxic"))
    no_id = rows.where("doc_id is null").select("name", "doc_id", "part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    # A text's first id and how many rows have it, by part and label: few rows a text, however many copies it has.
    kind = ("part", "mask", "good", "toxic")
    few = marked.unionByName(no_id).groupBy("name", "doc_id", *kind).agg(F.sum("n").alias("n")).groupBy("name", *kind)
    few = few.agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    least = F.min("first").over(Window.partitionBy("name"))
    whole = few.withColumn("fresh", F.col("n_null") + F.when(F.col("first") == least, F.col("n_first")).otherwise(0))
    both = F.array(F.struct(F.col("mask"), F.col("fresh").alias("n")), F.struct((F.col("mask") + bit[repeats]).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))
    split = whole.select("part", "good", "toxic", F.explode(both).alias("c")).select("part", "c.mask", "c.n", "good", "toxic")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, str], repeats: str) -> DataFrame:
    """Rows of ``STEPS``: for each part of ``docs`` (doc_id, text, source), every order of the filters and every step in it.

    Null texts are empty; a null source is the part of the empty string. A row without an id fails no repeat filter and makes no other row
    fail it; rows with the same id and text are no repeats of each other. ``labels`` (doc_id, quality, toxic): a document is good or
    toxic if one of its labels says so; nulls say nothing. Clashing and further columns are ignored; no rows give no rows. At most
    ``MOST_FILTERS`` filters, as the result has a row for each order and step.
    """
    names = "".join(sorted({*conditions, repeats}))
    if len(names) > MOST_FILTERS or any(len(f) != 1 for f in conditions):
        raise ValueError(f"at most {MOST_FILTERS} filters, each named by one letter")
    docs, labels = masked(docs, "doc_id", "text", "source"), masked(labels, "doc_id", "quality", "toxic")

    def orders(pdf: pd.DataFrame) -> pd.DataFrame:
        own = {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in pdf.itertuples() if r.n}
        return pd.DataFrame(walk(pdf.part.iloc[0], own, names), columns=[x.split()[0] for x in STEPS.split(", ")])

    return cells(docs, labels, conditions, repeats).groupBy("part").applyInPandas(orders, STEPS)


#: Whether a text (text, and its words ws) fails each filter of the query.
CONDITIONS = {
    "A": "size(ws) < 50",
    "B": "100 * size(array_distinct(ws)) < 65 * size(ws)",
    "C": "100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(text)",
    "D": "length(text) > length(translate(text, '#$%&*|', ''))",
}


def op13_interaction(spark, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), CONDITIONS, "E")


OP13_SQL = r"""
with lab as (select doc_id, coalesce(max(quality), 0) = 1 as good, coalesce(max(toxic), 0) = 1 as toxic from labels group by doc_id),
d as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), first as (select text, min(doc_id) as first from d group by text),
failing as (
    select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
        list_filter([case when len(ws) < 50 then 'A' end, case when 100 * len(list_distinct(ws)) < 65 * len(ws) then 'B' end,
            case when 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) then 'C' end,
            case when regexp_matches(text, '[#$%&*|]') then 'D' end, case when coalesce(doc_id > first, false) then 'E' end], lambda x: x is not null) as fails
    from d join first using (text) left join lab using (doc_id)
), cell as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from failing group by part, fails),
f(x) as (select unnest(['A', 'B', 'C', 'D', 'E'])),
perm as (
    select a.x || b.x || c.x || d.x || e.x as filter_order from f a join f b on b.x <> a.x join f c on c.x not in (a.x, b.x)
        join f d on d.x not in (a.x, b.x, c.x) join f e on e.x not in (a.x, b.x, c.x, d.x)
), place as (select filter_order, k::int as step, filter_order[k] as x, string_split(filter_order[1 : k - 1], '') as prior from perm, range(1, 6) t(k)),
counted as (
    select part, filter_order, step, any_value(x) as x,
        coalesce(sum(n) filter (not list_has_any(fails, prior) and not list_contains(fails, x)), 0) as kept,
        coalesce(sum(n) filter (not list_has_any(fails, prior) and list_contains(fails, x)), 0) as removed,
        coalesce(sum(n) filter (list_has_any(fails, prior) and list_contains(fails, x)), 0) as redundant,
        coalesce(sum(n) filter (fails = [x]), 0) as unique_fails,
        coalesce(sum(good) filter (not list_has_any(fails, prior) and list_contains(fails, x)), 0) as good_lost,
        coalesce(sum(toxic) filter (not list_has_any(fails, prior) and list_contains(fails, x)), 0) as toxic_lost
    from cell, place group by part, filter_order, step
)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
    good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, x))::bigint as shapley from counted
"""
