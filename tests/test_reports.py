"""Bootstrap intervals and session summaries against plain loops."""

import datetime as dt
import random
import re

import pytest

from engram.operators import resampling, summaries
from engram.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plain_bootstrap(values, iterations=2000):
    seed, means = 42, []
    for _ in range(iterations):
        total = 0.0
        for _ in values:
            seed = (seed * 1103515245 + 12345) & 0x7FFFFFFF
            total += values[min(len(values) - 1, int(seed / 0x7FFFFFFF * len(values)))]
        means.append(total / len(values))
    means.sort()
    point = 0.0
    for v in values:
        point += v
    return means[int(0.025 * iterations)], point / len(values), means[int(0.975 * iterations)]


def test_bootstrap_bit_for_bit(spark):
    rng = random.Random(5)
    groups = {"a": [rng.random() for _ in range(37)], "b": [1.5], "c": [rng.gauss(0, 1) for _ in range(90)]}
    rows = [(g, i, v) for g, vs in groups.items() for i, v in enumerate(vs)] + [("a", 999, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, x double")
    got = {r.g: (r.lower, r.point, r.upper) for r in resampling.bootstrap_mean(df, "g", "i", "x", 400).collect()}
    assert got == {g: plain_bootstrap(vs, 400) for g, vs in groups.items()}
    assert resampling.bootstrap_mean(df.limit(0), "g", "i", "x").count() == 0


def test_bootstrap_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("label", "vec_id", "embedding").orderBy("vec_id").collect()
    values = {}
    for r in rows:
        values.setdefault(r.label, []).append(float(r.embedding[0]))
    got = {r.label: (r.lower, r.point, r.upper) for r in QUERIES["bootstrap_interval"](spark, SF).collect()}
    assert got == {k: plain_bootstrap(v) for k, v in values.items()}


def plain_summary(session, events):
    flat = lambda s: re.sub(r"\s+", " ", s or "").strip()
    cut = lambda s, n: s if len(s) <= n else s[: n - 3].rstrip() + "..."
    events = sorted(events, key=lambda e: (e["created_at"], e["id"]))
    types = sorted(((-sum(e["type"] == t for e in events), t.replace("_", " "), t) for t in summaries.TYPES if any(e["type"] == t for e in events)))
    tools = sorted({flat(e["tool"]) for e in events} - {""})
    seen, spelled = {}, {}
    for e in events:
        if k := flat(e["topic"]).lower():
            seen[k] = seen.get(k, 0) + 1
            spelled.setdefault(k, (len(spelled), flat(e["topic"])))
    topics = [spelled[k][1] for k in sorted(seen, key=lambda k: (-seen[k], spelled[k][0]))][:5]
    some = lambda x: ", ".join(x) or "none"
    counts = ", ".join(f"{label} ({-n})" for n, label, _ in types[:3]) or "no strong type signal"
    short = cut(f"[Session] {len(events)} events: {counts}. Tools: {some(tools)}. Topics: {some(topics)}.", 400)
    lines = [f"Session {session} overview", f"Events: {len(events)}", f"Tools: {some(tools)}", f"Topics: {some(topics)}"]
    for n, label, t in types:
        ranked = sorted((e for e in events if e["type"] == t), key=lambda e: (round(e["salience"] + e["novelty"] + e["boost"], 9), e["created_at"], e["id"]), reverse=True)
        said = list(dict.fromkeys(x for x in (cut(flat(e["excerpt"]) or flat(e["title"]), 120) for e in ranked) if x))[:2]
        lines.append(f"{label} ({-n}): {' | '.join(said) or 'No representative excerpts.'}")
    if not types:
        lines.append("Types: no representative evidence.")
    medium = ""
    for line in lines:
        longer = f"{medium}\n{line}" if medium else line
        if len(longer) > 1000:
            medium = medium or cut(line, 1000)
            break
        medium = longer
    latest = [e["id"] for e in sorted(events, key=lambda e: (e["created_at"], e["id"]), reverse=True)[:20]]
    return session, len(events), tools or None, topics or None, latest, short, medium


def test_summaries(spark):
    rng = random.Random(4)
    names = "session_id id created_at tool type topic title excerpt salience novelty boost".split()
    rows = []
    for k in range(400):
        s = rng.choice([1, 1, 1, 2, 3, 4])
        kind = rng.choice([*summaries.TYPES, "other"]) if s != 4 else "other"
        tool = rng.choice(["bash", "edit  file", None, " "]) if s != 3 else "a tool with a very long name number " + str(k)
        rows.append((s, k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(50)), tool, kind, rng.choice(["A:b", "a:B", "x", None, "", "long " * 60]), rng.choice(["t", None, "w " * 90]), rng.choice([None, " ", "same\n text", "e" * rng.randrange(1, 300)]), rng.random(), 0.8, rng.choice([0.0, 0.15])))
    schema = "session_id long, id long, created_at timestamp, tool string, type string, topic string, title string, excerpt string, salience double, novelty double, boost double"
    got = summaries.summarise(spark.createDataFrame(rows, schema)).select("session_id", "event_count", "tools", "topics", "source_ids", "short", "medium").collect()
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(dict(zip(names, r, strict=True)))
    assert sorted(map(tuple, got)) == [plain_summary(s, by[s]) for s in sorted(by)]


@pytest.mark.parametrize("name", ["session_summary_texts", "materialize_candidates", "event_end_state"])
def test_events_are_read_from_what_was_saved(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # event_end_state reads all events once more, for the noise that it discards.
    assert plan.count("get_json_object(props") <= (name == "event_end_state")
