"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

``counts`` gives what the rules speak of (lengths, symbols, stop words, lines and repeats of a whole text) and ``verdict`` turns a
table of ``Rule`` into one column of the rules that a text breaks. All shares are compared as whole numbers, so results don't
depend on the order of sums. Nothing is exploded, grouped or shuffled: a row needs its own text only.

A lambda's body is evaluated again for each element, so arrays that it looks into are bound first (``_let``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, text_of, words

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\v\f\r"
#: Frequent function words of the languages that the table knows.
STOP_WORDS = (
    *("the", "and", "of", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "at", "this"),
    *("de", "la", "que", "el", "en", "y", "los", "las", "se", "del", "un", "por", "con", "una", "para"),
    *("le", "et", "les", "des", "du", "une", "est", "pour", "dans", "au", "sur"),
    *("der", "die", "und", "den", "von", "das", "zu", "sich", "mit", "für", "auf", "im", "ein"),
)
WINDOW = 5


class Rule(NamedTuple):
    """``part`` per thousand of ``whole`` must lie between ``least`` and ``most``, in texts of at least ``from_words`` words."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None
    from_words: int = 1


#: The method's thresholds. A text that has nothing of ``whole`` breaks no rule.
TABLE = (
    Rule("word_length", "word_chars", "n_words", 2000, 12000),
    Rule("symbols", "n_symbols", "n_words", most=100),
    Rule("exclamations", "n_exclamations", "n_words", most=500),
    Rule("capitals", "n_capitals", "word_chars", most=400),
    Rule("stop_words", "n_stop", "n_words", least=30, from_words=100),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=400),
    Rule("cut_lines", "n_cut_lines", "n_lines", most=500),
    Rule("bullets", "n_bullets", "n_lines", most=900),
)
#: What every text must have before the table is asked.
BASE = (Rule("few_words", "n_words", "one", least=10_000, from_words=0), Rule("repeats", "n_repeat_words", "n_words", most=200))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(ws: Column, window: int = WINDOW) -> Column:
    """Words of the array column ``ws`` in runs of ``window`` words that it holds at least twice.

    Hashes tell whether anything repeats at all; only then are the runs themselves sorted and compared, so no collision counts.
    """
    places = F.sequence(F.lit(0), F.size(ws) - window)
    run = lambda a, i: [F.get(a, i + k) for k in range(window)]
    hashes = _let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: F.transform(places, lambda i: F.xxhash64(*run(h, i))))
    pairs = lambda h: F.sort_array(F.transform(places, lambda i: F.struct(F.get(h, i).alias("h"), F.concat_ws(" ", *run(ws, i)).alias("run"), i.alias("at"))))
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["run"] == y["run"]), F.lit(False))
    twice = lambda s: F.transform(s, lambda x, i: F.when(same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)), x["at"]))
    starts = lambda h: F.sort_array(F.array_compact(_let(pairs(h), twice)))
    covered = lambda p: F.aggregate(F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(window)), F.lit(window))), F.lit(0), lambda a, n: a + n)
    counted = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(starts(h), covered)))
    return F.when(F.size(ws) < window, 0).otherwise(counted)


def counts(docs: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """doc_id and, as long, every count that a rule can name, of each row of ``docs``.

    A null text is empty and has zeros; null and repeated ids stay as they are, a row each; other columns are ignored; no rows
    give no rows. Lines are split at line feeds; lines without a word aren't counted.
    """
    cut = F.filter(F.split(F.col("text"), "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    held = docs.select("doc_id", text_of().alias("text")).select("doc_id", "text", words(F.col("text")).alias("ws"), cut.alias("ls"))
    without = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    lines = lambda test: F.size(F.filter("ls", test))
    found = {
        "n_words": F.size("ws"),
        "word_chars": F.length(F.translate("text", BLANK, "")),
        "n_symbols": without(SYMBOLS),
        "n_exclamations": without("!?"),
        "n_capitals": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_stop": F.size(F.filter("ws", lambda w: F.lower(w).isin(*stop_words))),
        "n_lines": F.size("ls"),
        "n_dup_lines": F.size("ls") - F.size(F.array_distinct("ls")),
        "n_cut_lines": lines(lambda x: x.endswith("...") | x.endswith("…")),
        "n_bullets": lines(lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("• ")),
        "n_repeat_words": repeat_words(F.col("ws")),
    }
    return held.select("doc_id", *(c.cast("long").alias(n) for n, c in found.items()))


def verdict(table: Sequence[Rule]) -> Column:
    """An array of the names of the rules of ``table`` that a row of ``counts`` breaks, in the table's order."""
    def broken(r: Rule) -> Column:
        whole = F.lit(1) if r.whole == "one" else F.col(r.whole)
        low = F.lit(False) if r.least is None else F.col(r.part) * 1000 < whole * r.least
        high = F.lit(False) if r.most is None else F.col(r.part) * 1000 > whole * r.most
        return F.when((F.col("n_words") >= r.from_words) & (whole > 0) & (low | high), F.lit(r.name))

    return F.array_compact(F.array(*map(broken, table)))


def judged(docs: DataFrame, table: Sequence[Rule] = TABLE, base: Sequence[Rule] = BASE) -> DataFrame:
    """``counts`` with base_failed, kept and failed: the names of all broken rules, joined by commas."""
    rows = counts(docs).select("*", verdict(base).alias("base"), verdict(table).alias("more"))
    rows = rows.select("*", (F.size("base") > 0).alias("base_failed"), F.concat("base", "more").alias("all"))
    return rows.select("*", (F.size("all") == 0).alias("kept"), F.array_join("all", ",").alias("failed")).drop("base", "more", "all")


def op11_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents"))


def _sql_rule(r: Rule) -> str:
    whole = "1" if r.whole == "one" else r.whole
    tests = [f"{r.part} * 1000 < {whole} * {r.least}"] * (r.least is not None) + [f"{r.part} * 1000 > {whole} * {r.most}"] * (r.most is not None)
    return f"case when n_words >= {r.from_words} and {whole} > 0 and ({' or '.join(tests)}) then '{r.name}' end"


def _sql_broken(table: Sequence[Rule]) -> str:
    return f"list_filter([{', '.join(map(_sql_rule, table))}], lambda x: x is not null)"


OP11_SQL = rf"""
with d as (
    select row_number() over () as rid, doc_id, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents
), run as (select rid, unnest(range(1, len(ws) - {WINDOW - 2})) as pos, ws from d where len(ws) >= {WINDOW}),
named as (select rid, pos, ws[pos : pos + {WINDOW - 1}] as words from run),
twice as (select rid, pos from named qualify count(*) over (partition by rid, words) > 1),
cover as (select rid, count(distinct p) as n from (select rid, unnest(range(pos, pos + {WINDOW})) as p from twice) group by rid),
c as (
    select doc_id, len(ws) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
        len(regexp_extract_all(text, '[!?]')) as n_exclamations, len(regexp_extract_all(text, '[A-Z]')) as n_capitals,
        len(list_filter(ws, lambda w: lower(w) in {STOP_WORDS})) as n_stop, len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines,
        len(list_filter(ls, lambda x: ends_with(x, '...') or ends_with(x, '…'))) as n_cut_lines,
        len(list_filter(ls, lambda x: starts_with(x, '- ') or starts_with(x, '* ') or starts_with(x, '• '))) as n_bullets, coalesce(n, 0) as n_repeat_words
    from d left join cover using (rid)
), v as (select *, {_sql_broken(BASE)} as base, {_sql_broken(TABLE)} as more from c)
select * exclude (base, more), len(base) > 0 as base_failed, len(base) + len(more) = 0 as kept, array_to_string(list_concat(base, more), ',') as failed from v
"""
