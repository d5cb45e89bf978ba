"""Quality rules against a plain loop."""

import random
import re

from engram.llm import rules

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def plain(text: str) -> dict:
    ws = [w for w in SPACE.split(text) if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    runs = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    hit = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(5)}
    out = {
        "n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_exclamations": sum(c in "!?" for c in text),
        "n_capitals": sum("A" <= c <= "Z" for c in text), "n_stop": sum(w.lower() in rules.STOP_WORDS for w in ws), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_cut_lines": sum(x.endswith(("...", "…")) for x in lines),
        "n_bullets": sum(x.startswith(("- ", "* ", "• ")) for x in lines), "n_repeat_words": len(hit),
    }
    base = [n for n, bad in (("few_words", len(ws) < 10), ("repeats", 100 * len(hit) > 20 * len(ws))) if bad]
    more = []
    for r in rules.TABLE:
        if out["n_words"] >= r.from_words and out[r.whole]:
            share = 1000 * out[r.part]
            if (r.least is not None and share < r.least * out[r.whole]) or (r.most is not None and share > r.most * out[r.whole]):
                more.append(r.name)
    return out | {"base_failed": bool(base), "kept": not base + more, "failed": ",".join(base + more)}


def test_judged(spark):
    rng = random.Random(11)
    pool = "the of and Zug éü𝄞 x,y !! # $5 de la ver... - •".split(" ")
    texts = [None, "", " \n\t", "one", "a b c d e " * 3, "w\n" * 30, "same line here\n" * 20, "- x ...\n" * 12, "A B " * 12, "\r\n\v\f", "x" * 50_000 + " y"]
    texts += ["".join(rng.choice(pool) + rng.choice(" \n  ") for _ in range(rng.randrange(80))) for _ in range(150)]
    texts += [" ".join(f"w{rng.randrange(3)}" for _ in range(60)) for _ in range(20)]
    rows = [(None if i == 3 else i // 2, t, "own") for i, t in enumerate(texts)]  # repeated and null ids, a clashing column
    got = rules.judged(spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(3)).collect()
    want = [{"doc_id": i} | plain(t or "") for i, t, _ in rows]
    key = lambda r: sorted(map(str, r.items()))
    assert sorted((r.asDict() for r in got), key=key) == sorted(want, key=key)
    assert len({r.failed for r in got}) > 8


def test_no_rows_and_one_projection(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert rules.judged(docs).count() == 0
    plan = rules.judged(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_own_table(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a #")], "doc_id long, text string")
    out = rules.judged(docs, table=(rules.Rule("signs", "n_symbols", "n_words", most=0),), base=())
    assert {(r.doc_id, r.kept, r.failed) for r in out.collect()} == {(1, True, ""), (2, False, "signs")}
