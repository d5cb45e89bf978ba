"""Queries of the evidence state machine and of session summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SUCCESS, TOPIC
from ..operators import states, summaries
from ..sources import adapters as src
from .queries import AS_OF, E, M, TAG_SQL, TYPE_SQL, query

STAMP = "timestamp_ntz"


def _at_risk(spark, sf) -> DataFrame:
    """At-risk memories, with scopes like those of the events."""
    old = F.col("last_verified_at") < F.lit(AS_OF).cast(STAMP) - F.expr("interval 7 days")
    m = src.memories(spark, sf).where("status = 'active'").where(F.col("last_verified_at").isNull() | old | (F.col("confidence") < 0.7))
    scope = F.floor(F.col("seq") / 4) % 4
    glob = F.when(F.col("seq") % 4 == 0, F.when(F.col("seq") % 3 == 0, "**/*").otherwise("docs/**")).when(F.col("seq") % 4 == 1, F.concat(F.lit("src/"), scope, F.lit("/**/*"))).when(F.col("seq") % 4 == 2, F.concat(F.lit("src/"), scope)).otherwise("docs/**")
    return m.withColumn("scope_glob", glob)


def _events(spark, sf) -> DataFrame:
    return states.with_signals(src.evidence(spark, sf).where(F.col("status").isin("pending", "retained")))


def _run(spark, sf, save=lambda df: df):
    """At-risk memories, claimed events and judgement; ``save`` keeps events and claims where several steps read them."""
    risk = _at_risk(spark, sf)
    claimed = save(states.claims(save(_events(spark, sf)), risk))
    return risk, claimed, save(states.judged(claimed))


RISK = f"""risk as (select id, type, confidence, last_verified_at, updated_at, created_at, case seq % 4 when 0 then case when seq % 3 = 0 then '**/*' else 'docs/**' end when 1 then 'src/' || (seq // 4 % 4)::varchar || '/**/*' when 2 then 'src/' || (seq // 4 % 4)::varchar else 'docs/**' end as gl
 from memories where status = 'active' and (last_verified_at is null or last_verified_at < timestamp '{AS_OF}' - interval 7 day or confidence < 7e-1))"""
found = lambda k: f"nullif(regexp_extract(low, '{TOPIC[k]}', 1), '')"
TOPIC_SQL = f"""type || ':' || scope_ref || ':' || case type when 'pitfall' then coalesce({found('pitfall')}, tool) when 'policy' then coalesce({found('policy')}, 'policy') when 'decision' then coalesce(regexp_replace({found('decision')}, '\\s+', '-', 'g'), tool)
 when 'architecture_constraint' then coalesce({found('architecture_constraint')}, 'structure') else case when regexp_matches(low, 'passed|resolved|fixed|migrated') then 'verified-flow' else tool end end"""
CLAIMED = f"""{M}, {E}, {RISK}, evt0 as (select *, {TAG_SQL} as tags, {TYPE_SQL} as type, lower(tool || ' ' || excerpt) as low from evidence where status in ('pending','retained')), evt as (select *, {TOPIC_SQL} as topic from evt0),
won as (select type, scope_ref, arg_min(id, (coalesce(epoch_us(last_verified_at), -4611686018427387904), confidence, id)) as memory_id from (select e.type, e.scope_ref, r.* exclude (type) from (select distinct type, scope_ref from evt) e join risk r on r.type = e.type
  and (gl = e.scope_ref or gl = e.scope_ref || '/**/*' or gl = '**/*' or (ends_with(gl, '/**/*') and (e.scope_ref = gl[:-6] or starts_with(e.scope_ref, gl[:-6] || '/'))))) group by all),
claimed as (select e.*, memory_id from evt e left join won using (type, scope_ref)),
jud as (select memory_id, count(*) as n_events, max(created_at) as verified_at, list_contains(flatten(list(tags)), 'temporal_cue') and (list_contains(flatten(list(tags)), 'decision_signal') or list_contains(flatten(list(tags)), 'explicit_marker')) as contradicted from claimed where memory_id is not null group by memory_id),
marked as (select c.*, contradicted from claimed c left join jud using (memory_id) where contradicted is null or contradicted),
g as (select session_id, scope_ref, tool, min(created_at) as first_at, max(created_at) as last_at from marked group by all),
i0 as (select *, max(last_at) over (partition by session_id, scope_ref order by first_at, last_at, tool rows between unbounded preceding and 1 preceding) as b from g),
isl as (select *, sum(case when b is null or first_at >= b + interval 5 minute then 1 else 0 end) over (partition by session_id, scope_ref order by first_at, last_at, tool)::int as island from i0),
placed as (select m.*, island from marked m join isl using (session_id, scope_ref, tool)),
mg as (select session_id, scope_ref, island, count(*) as n, list_sort(list_distinct(flatten(list(tags)))) as gtags, arg_min(id, (created_at, id)) as lead_id, count(distinct memory_id) as n_targets from placed group by all),
tiered as (select *, case when n >= 3 then 1 when list_contains(gtags, 'failure_signal') and list_contains(gtags, 'has_file_context') then 1 when n >= 2 then 2 when len(gtags) > 0 then 2 when n_targets > 0 then 2 else 3 end as tier from mg)"""


@query(f"with {CLAIMED} select id, memory_id from claimed where memory_id is not null")
def evidence_claims(spark, sf):
    """Each event with the first at-risk memory that claims it."""
    return _run(spark, sf)[1].where("memory_id is not null").select("id", "memory_id")


@query(f"""with {CLAIMED} select r.id, case when contradicted then 'contradicted' when contradicted is not null then 'reinforced' when coalesce(last_verified_at, updated_at, created_at) < timestamp '{AS_OF}' - interval 14 day then 'stale' else 'kept' end as outcome,
 coalesce(n_events, 0) as n_events, round(case when not contradicted then least(99e-2, confidence + 5e-2) else confidence end, 6) as confidence from risk r left join jud j on j.memory_id = r.id""")
def reconcile_at_risk(spark, sf):
    """At-risk memories reinforced or contradicted by the events they claim; others go stale after 14 days."""
    risk, _, judgement = _run(spark, sf)
    return states.reconcile(risk, judgement, AS_OF).withColumn("confidence", F.round("confidence", 6))


@query(f"with {CLAIMED} select id, 'discarded' as state from evidence where trim(title) = '' and trim(excerpt) = '' and trim(args_json) = '' union all select id, 'materialized' from claimed join jud using (memory_id) where not contradicted union all select p.id, case when tier = 3 then 'latent' else 'materialized' end from placed p join tiered using (session_id, scope_ref, island)")
def event_end_state(spark, sf):
    _, claimed, judgement = _run(spark, sf, src.stored)
    placed, groups = states.grouped(claimed, judgement, src.stored)
    return states.end_states(src.evidence(spark, sf), claimed, judgement, placed, groups)


@query(f"""with {CLAIMED}, lead as (select t.*, p.type, p.topic, p.created_at as lead_at from tiered t join placed p on p.id = t.lead_id where tier <= 2),
ln as (select session_id, scope_ref, island, string_agg(line, chr(10) order by nth) as lines from (select *, row_number() over (partition by session_id, scope_ref, island order by created_at, id) as nth, '- ' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || ' :: ' || tool || ' :: ' || title || ' :: ' || excerpt as line from placed) where nth <= 20 group by all),
tl as (select session_id, scope_ref, island, list_distinct(list(tool)) as tools from placed group by all),
h as (select *, sha256('dream-candidate:' || type || ':' || scope_ref || ':' || topic) as h, case type when 'pitfall' then 'Pitfall around' when 'policy' then 'Policy for' when 'architecture_constraint' then 'Architecture constraint for' when 'decision' then 'Decision for' else 'Workflow for' end || ' ' || split_part(scope_ref, '/', -1) || ' (' || topic || ')' as summary from lead join ln using (session_id, scope_ref, island) join tl using (session_id, scope_ref, island)),
ids as (select *, h[1:8] || '-' || h[9:12] || '-' || '5' || h[14:16] || '-' || ['8','9','a','b'][(strpos('0123456789abcdef', h[17:17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] as id from h),
num as (select *, row_number() over (partition by id order by lead_at, lead_id) as nth, row_number() over (partition by id order by lead_at desc, lead_id desc) as back, list_distinct(flatten(list(tools) over (partition by id))) as all_tools from ids)
select id, type, summary, case when nth > 1 then 'Previous understanding:' || chr(10) || summary || chr(10) || chr(10) || 'New evidence:' else 'Dream consolidation candidate built from recent evidence:' end || chr(10) || lines as details, scope_ref || '/**/*' as scope_glob,
 case type when 'workflow' then 'before_model,after_tool' when 'pitfall' then 'before_tool' when 'policy' then 'before_tool,before_model' else 'session_start,before_model' end as triggers, array_to_string(list_sort(all_tools), ',') as tools,
 round(case tier when 1 then least(95e-2, 8e-1 + n * 2e-2) else least(85e-2, 6e-1 + n * 5e-2) end, 6) as confidence, case when nth > 1 then 'updated' else 'created' end as action from num where back = 1""")
def materialize_candidates(spark, sf):
    """Candidates with deterministic ids, texts, triggers and the union of tools."""
    _, claimed, judgement = _run(spark, sf, src.stored)
    placed, groups = states.grouped(claimed, judgement, src.stored)
    existing = src.memories(spark, sf).select("id", "summary", "relevant_tools")
    return states.materialised(placed, groups, existing).drop("importance").withColumn("confidence", F.round("confidence", 6))


@query(f"with {E} select id from evidence where status in ('pending','retained') and created_at >= timestamp '2024-01-15 12:00:00' - interval 24 hour and created_at <= timestamp '2024-01-15 12:00:00' order by created_at, id limit 50")
def evidence_window(spark, sf):
    """The first fifty processable events of a day."""
    return states.evidence_window(src.evidence(spark, sf), "2024-01-15 12:00:00").select("id")


# ---- session summaries ---------------------------------------------------------------------------------------------


def summarised(events: DataFrame, least: int = 3, topics: int = 5) -> DataFrame:
    """(session_id, n_events, top_topics, tools, short): sessions of at least ``least`` events with their commonest topics (ties: first seen) and a short text of at most 400 characters."""
    by = events.groupBy("session_id", "topic").agg(F.count("*").alias("n"), F.min(F.struct("created_at", "id")).alias("first"))
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "first"))
    best = by.withColumn("nth", nth).where(F.col("nth") <= topics).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "topic"))), lambda x: x["topic"]), ", ").alias("top_topics"))
    tools = events.select("session_id", "tool").distinct().groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list("tool")), ", ").alias("tools"))
    counts = events.groupBy("session_id").agg(F.count("*").alias("n_events")).where(F.col("n_events") >= least)
    text = F.concat(F.lit("Session with "), F.col("n_events"), F.lit(" events. Tools: "), F.col("tools"), F.lit(". Topics: "), F.col("top_topics"), F.lit("."))
    return counts.join(best, "session_id").join(tools, "session_id").withColumn("short", F.when(F.length(text) > 400, F.concat(F.rtrim(F.substring(text, 1, 397)), F.lit("..."))).otherwise(text))


@query(f"""with {E}, evt0 as (select *, {TYPE_SQL} as type, lower(tool || ' ' || excerpt) as low from evidence), evt as (select *, {TOPIC_SQL} as topic from evt0), byt as (select session_id, topic, count(*) as n, min((created_at, id)) as f from evt group by all),
best as (select session_id, string_agg(topic, ', ' order by k) as top_topics from (select *, row_number() over (partition by session_id order by n desc, f) as k from byt) where k <= 5 group by session_id),
tl as (select session_id, array_to_string(list_sort(list_distinct(list(tool))), ', ') as tools, count(*) as n_events from evt group by session_id having count(*) >= 3),
tx as (select *, 'Session with ' || n_events || ' events. Tools: ' || tools || '. Topics: ' || top_topics || '.' as t from tl join best using (session_id))
select session_id, n_events, top_topics, tools, case when length(t) > 400 then rtrim(substr(t, 1, 397)) || '...' else t end as short from tx""")
def session_summaries(spark, sf):
    return summarised(states.with_signals(src.evidence(spark, sf)))


#: Stored summaries of every third session, some of them half an hour old; events as they were an hour before the end.
NOW = "timestamp '2024-02-01 12:00:00'"
FULL = f"""{E}, evt0 as (select *, {TYPE_SQL} as type, lower(tool || ' ' || excerpt) as low, row_number() over (partition by session_id order by created_at, id) % 10 = 0 as tenth from evidence), evt1 as (select *, {TOPIC_SQL} as topic from evt0),
evt as (select *, case when trim(excerpt) <> '' then trim(excerpt) else trim(title) end as said, round(least(1e0, 45e-2 + case when type = 'pitfall' then 25e-2 when type in ('policy','decision') then 15e-2 when type = 'architecture_constraint' then 1e-1 else 0e0 end
  + case when regexp_matches(title || ' ' || excerpt, '(?i){SUCCESS}') then 1e-1 else 0e0 end + case when tool = 'bash' then 5e-2 else 0e0 end) + 8e-1 + case when type in ('decision','architecture_constraint') then 1e-1 else 0e0 end + case when tenth then 15e-2 else 0e0 end, 9) as score from evt1),
tp as (select session_id, string_agg(topic, ', ' order by k) as topics from (select session_id, topic, row_number() over (partition by session_id order by count(*) desc, min((created_at, id))) as k from evt group by session_id, topic) where k <= 5 group by session_id),
tl as (select session_id, array_to_string(list_sort(list_distinct(list(tool))), ', ') as tools, count(*) as event_count from evt group by session_id),
ids as (select session_id, string_agg(id::varchar, ',' order by k) as source_ids from (select session_id, id, row_number() over (partition by session_id order by created_at desc, id desc) as k from evt) where k <= 20 group by session_id),
sn as (select session_id, type, string_agg(said, ' | ' order by k) as line from (select session_id, type, said, row_number() over (partition by session_id, type order by max((score, created_at, id)) desc) as k from evt group by session_id, type, said) where k <= 2 group by 1, 2),
ty as (select session_id, type, count(*) as n, replace(type, '_', ' ') as label from evt group by all),
tys as (select session_id, list(label || ' (' || n || ')' order by n desc, label) as kinds, list(label || ' (' || n || '): ' || line order by n desc, label) as lines from ty join sn using (session_id, type) group by session_id),
ln as (select tl.*, topics, source_ids, kinds, list_concat(['Session ' || session_id || ' overview', 'Events: ' || event_count, 'Tools: ' || tools, 'Topics: ' || topics], lines) as lines from tl join tp using (session_id) join ids using (session_id) join tys using (session_id)),
full_ as (select session_id, event_count, source_ids, '[Session] ' || event_count || ' events: ' || array_to_string(kinds[1:3], ', ') || '. Tools: ' || tools || '. Topics: ' || topics || '.' as s,
  array_to_string(lines[1 : coalesce(list_max(list_filter(range(1, len(lines) + 1), lambda i: length(array_to_string(lines[1:i], chr(10))) <= 1000)), 0)], chr(10)) as medium from ln),
gen as (select session_id, event_count, source_ids, case when length(s) > 400 then rtrim(left(s, 397)) || '...' else s end as short, medium from full_)"""


def _scored_events(spark, sf: str) -> DataFrame:
    tenth = F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "id")) % 10 == 0
    return states.with_signals(src.evidence(spark, sf)).withColumn("boost", F.when(tenth, 0.15).otherwise(0.0))


@query(f"with {FULL} select * from gen")
def session_summary_texts(spark, sf):
    """Short and medium summaries of all sessions, with their latest events."""
    return summaries.summarise(_scored_events(spark, sf), src.stored).select("session_id", "event_count", F.array_join("source_ids", ",").alias("source_ids"), "short", "medium")


@query(f"""with {FULL}, stored as (select distinct session_id, {NOW} - to_minutes((session_id % 60)::int) as updated_at from evidence where session_id % 3 = 0)
select session_id, coalesce(g.short, 'old') as short, coalesce(s.updated_at, {NOW}) as created_at, case when g.session_id is null then s.updated_at else {NOW} end as updated_at, case when s.session_id is not null then session_id::double end as vector, case when s.session_id is not null then 1 else 2 end as since
 from stored s full join (select * from gen where event_count >= 3 and session_id not in (select session_id from stored where updated_at > {NOW} - interval 30 minute)) g using (session_id)""")
def summary_refresh(spark, sf):
    """Stored summaries after one refresh: what is younger than half an hour stays, creation times and vectors are kept. ``since``: the version that first has the session."""
    at = F.lit("2024-02-01 12:00:00").cast(STAMP)
    events = _scored_events(spark, sf)
    blank = summaries.summarise(events.limit(0)).schema
    held = events.where("session_id % 3 = 0").select("session_id").distinct().withColumn("short", F.lit("old"))
    old = held.select(*(F.col(f.name) if f.name in held.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in blank), F.array(F.col("session_id").cast("double")).alias("vector"))
    times = at - F.make_dt_interval(F.lit(0), F.lit(0), (F.col("session_id") % 60).cast("int"))
    s = src.store(spark, "summaries")
    first = s.create(summaries.SUMMARIES, old.withColumn("created_at", times).withColumn("updated_at", times), ("session_id",))
    last = summaries.refresh(s, events, at, src.stored)
    before = s.read(summaries.SUMMARIES, first).select("session_id", F.lit(1).alias("since"))
    now = s.read(summaries.SUMMARIES, last).join(before, "session_id", "left")
    return now.select("session_id", "short", "created_at", "updated_at", F.col("vector")[0].alias("vector"), F.coalesce("since", F.lit(2)).alias("since"))
