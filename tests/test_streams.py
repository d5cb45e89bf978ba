"""Session state in streams against plain loops, across restarts."""

import datetime as dt
import random

from engram.operators.evidence import actions
from engram.streaming import buffers, sessions

START = dt.datetime(2024, 1, 1)
EVENTS = "session_id long, id long, created_at timestamp, tool string"


def run(df, path, table=None):
    """All that is there now, from the checkpoint on."""
    q = df.writeStream.format("parquet").option("path", f"{path}/{table}").option("checkpointLocation", f"{path}/{table}-cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def test_counters_go_on_after_a_restart(spark, tmp_path):
    rng = random.Random(2)
    sessions.rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        rows = [(rng.randrange(4), i, START + dt.timedelta(minutes=i), rng.choice([None, "bash"])) for i in range(120)]
        source, out = str(tmp_path / "in"), str(tmp_path)
        for part in (rows[:50], rows[50:]):  # two runs of the query; the second goes on from the checkpoint
            spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
            run(sessions.counted(spark.readStream.schema(EVENTS).parquet(source)), out, "counted")
        # Days later another session moves the watermark on: all others are idle, and one of them comes back.
        late = [(9, 500, START + dt.timedelta(days=3), None), (0, 501, START + dt.timedelta(days=3, hours=1), None)]
        for r in late:
            spark.createDataFrame([r], EVENTS).coalesce(1).write.mode("append").parquet(source)
            run(sessions.counted(spark.readStream.schema(EVENTS).parquet(source)), out, "counted")
        got = spark.read.parquet(f"{out}/counted").collect()
        n, tools, want = {}, {}, set()
        for s, i, at, tool in rows:
            n[s], tools[s] = n.get(s, 0) + 1, tools.get(s, 0) + (tool is not None)
            want.add((s, i, n[s], tools[s], n[s] % 10 == 0))
        seen = {(r.session_id, r.id, r.nth, r.tool_nth, r.boosted) for r in got if r.kind == "event"}
        assert want <= seen
        assert {(r.session_id, r.nth, r.tool_nth) for r in got if r.kind == "idle"} >= {(s, n[s], tools[s]) for s in n}
        assert (0, 501, 1, 0, False) in seen  # counted anew after it was idle
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_one_buffer_for_all_sessions(spark, tmp_path):
    rng = random.Random(3)
    sessions.rocksdb(spark)
    schema = "session_id long, id long, created_at timestamp, role string, tool string, title string, text string"
    rows = [(rng.randrange(3), i, START + dt.timedelta(seconds=i), "tool" if i % 3 == 0 else "user", "bash", "run", rng.choice([None, "hi", "x" * 400])) for i in range(38)]
    source, out = str(tmp_path / "in"), str(tmp_path)
    for part in (rows[:18], rows[18:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        run(sessions.conversation_batches(spark.readStream.schema(schema).parquet(source)), out, "batches")
    want = []
    for k in range(0, 35, 5):
        lines = []
        for _, _, _, role, tool, title, text in rows[k : k + 5]:
            text = text or ""
            lines.append(f"[tool] [{tool}] {title}: {text if len(text) <= 300 else text[:300] + '...'}" if role == "tool" else f"[user] {text}")
        want.append((0, k // 5, rows[k + 4][0], 5, "\n".join(lines)))
    assert sorted(map(tuple, spark.read.parquet(f"{out}/batches").collect())) == want


def test_late_events_and_repeated_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path)
    schema = "created_at timestamp, tool string"
    feed = [[(START + dt.timedelta(hours=12), "bash")], [(START + dt.timedelta(hours=8), "bash")], [(START, "bash")], [(START + dt.timedelta(days=2), "edit")], [(START + dt.timedelta(days=4), "edit")]]
    for rows in feed:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        run(buffers.activity(spark.readStream.schema(schema).parquet(source)), out, "activity")
    got = {(r.window.start, r.tool): r.n_events for r in spark.read.parquet(f"{out}/activity").collect()}
    assert got[(START + dt.timedelta(hours=8), "bash")] == 1 == got[(START + dt.timedelta(hours=12), "bash")]  # late, but within six hours
    assert (START, "bash") not in got  # later than the watermark


def test_a_repeated_evidence_batch_overwrites_itself(spark, tmp_path):
    from engram.sources import adapters

    events = adapters.evidence(spark, "/root/testdata/sf0.001")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, actions(events).collect()))
    for k in range(2):  # a new checkpoint: the same batch again
        q = buffers.run_evidence(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / f"cp{k}"))
        q.awaitTermination(180)
        got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
        assert sorted(map(tuple, got.select(*actions(events).columns).collect())) == want
