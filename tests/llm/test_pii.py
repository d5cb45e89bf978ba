"""Spans against Python's own patterns, and disclosing terms against a plain count."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from engram.llm import pii
from tests.llm.test_operators import AWKWARD, SF, frame

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _ok(kind, value):
    d = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def _base(text):
    return sorted((m.start(), k, kind, m.end()) for k, (kind, rule) in enumerate(RULES.items()) for m in re.finditer(rule, text) if _ok(kind, m.group()))


def test_base_spans_of_all_documents(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in pii.op7_pii(spark, SF).collect():
        spans = _base(texts[r.doc_id])
        n = Counter(kind for _, _, kind, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in RULES)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()


def test_one_line(spark):
    text = "Mail a.b@c.org or 10.0.0.256 10.0.0.25, card 4111 1111 1111 1111, call +1 (650) 253-0000."
    r = pii.find(frame(spark, [text])).first()
    assert [(s.kind, text[s.start : s.end]) for s in r.base] == [("email", "a.b@c.org"), ("ip", "10.0.0.25"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (650) 253-0000")]


def test_disclosing_terms_at_production_thresholds(spark):
    key = hashlib.sha1(b"k").hexdigest()
    texts = [f"{w} the codename bluebird belongs to p{k}@hush.org {w[::-1]} yes" for k, w in enumerate(("alpha", "bravo", "carol", "delta"))]
    texts += ["somewhere far away Bluebird was heard of again", f"take {key} now", None, "", "bluebirds differ"]
    texts += [texts[0]] * 50  # copies are one context
    texts += ["one more crossbow near q@rare.org end"] * 60  # in many rows, but one text
    texts += [f"ordinary text number {i} about things, the end" for i in range(1500)]
    rows = {r.doc_id: r for r in pii.find(frame(spark, texts)).where("doc_id < 120").collect()}
    added = {i: [(s.kind, (texts[i] or "")[s.start : s.end]) for s in r.added] for i, r in rows.items()}
    for i in range(4):
        assert ("generalise", "bluebird") in added[i] and ("generalise", "codename") in added[i]
        assert not any(t in ("the", "to") for _, t in added[i])
    assert added[4] == [("generalise", "Bluebird")] and added[5] == [("secret", key)]
    assert added[6] == added[7] == added[8] == [] and added[9] == added[0] and added[70] == []
    # The same terms by a plain count.
    distinct = {t or "" for t in texts}
    holds = defaultdict(set)
    for t in distinct:
        for w in set(re.findall(r"[^\W_]{3,}", t.lower())):
            holds[w].add(t)
    mine = [t for t in distinct if "@hush.org" in t]
    prior = len(mine) / len(distinct)
    share = lambda w: (sum(t in mine for t in holds[w]) + prior) / (len(holds[w]) + 1)
    for w in ("codename", "bluebird", "belongs"):
        assert 0.5 <= share(w) < 0.9 and math.log2(share(w) / prior) >= 6
    clean = pii.sanitise(frame(spark, texts)).where("doc_id in (0, 4, 5, 6)").collect()
    for r in clean:
        assert "@" not in r.text and "bluebird" not in r.text.lower() and key not in r.text
    assert {r.doc_id: r.text for r in clean}[5] == "take [secret] now"


def test_awkward_rows_and_clashing_names(spark):
    docs = frame(spark, AWKWARD)
    for name in ("row_key", "found_spans", "_text", "_spans", "flagged", "base"):
        docs = docs.selectExpr("*", f"'x' as {name}")
    out = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert len(out) == len(AWKWARD) and {r.row_key for r in out.values()} == {"x"} and {r._text for r in out.values()} == {"x"}
    assert [out[i].text for i in range(8)] == ["", "", *AWKWARD[2:7], "[email] [phone]"]
    assert pii.sanitise(docs.limit(0)).collect() == []
