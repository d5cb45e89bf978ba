"""Queries over records: ordered lists, links, rules, runs, updates, tiers and the health report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import lifecycle, retrieval
from ..sources import adapters as src
from .queries import AS_OF, COS, E, IDENTITY_SQL, M, query

#: Audit events and what each reports.
AUDIT_TYPES = ("activation", "session_summary_generated", "session_summary_skipped", "auto_promotion_cycle", "review_digest_shown")
MODES = ("startup", "default", "temporal", "cross_session")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
RULES = (("no-secrets", "before_tool", None), ("docs-style", "session_start", "m000000000003"), ("src0-owner", "before_model", "m000000000005"))
STAMP = "timestamp_ntz"


def links(spark, sf) -> DataFrame:
    """Events as links of memories: (memory_id, event_id, run_id, created_at); a run is a day."""
    e = src.read(spark, sf, "events")
    return e.select(F.concat(F.lit("m"), F.lpad(F.col("user_id").cast("string"), 12, "0")).alias("memory_id"), "event_id", F.date_format("ts", "yyyyMMdd").alias("run_id"), F.col("ts").alias("created_at"))


LINKS = "links as (select 'm' || lpad(user_id::varchar, 12, '0') as memory_id, event_id, strftime(ts, '%Y%m%d') as run_id, ts as created_at from events)"


def audit(spark, sf) -> DataFrame:
    """Orders as audit rows: (id, event_type, created_at, details) with details as JSON."""
    o = src.read(spark, sf, "orders")
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in zip(PRIORITIES, AUDIT_TYPES, strict=True) for x in pair)), F.col("o_orderpriority"))
    k = F.col("o_orderkey")
    details = F.struct(
        F.when(kind == "activation", F.element_at(F.array(*map(F.lit, MODES)), (k % 4 + 1).cast("int"))).alias("activationMode"),
        F.when(kind == "activation", F.col("o_custkey") % 7).alias("activatedCount"),
        F.when((kind == "activation") & (k % 3 == 0), k % 2 == 0).alias("startupPackInjected"),
        F.when((kind == "session_summary_skipped") & (k % 2 == 0), "recent").alias("reason"),
        F.when(kind == "auto_promotion_cycle", k % 3).alias("promotedCount"),
        F.when(kind == "auto_promotion_cycle", k % 5).alias("expiredCount"),
        F.when((kind == "review_digest_shown") & (k % 2 == 1), k % 9).alias("candidateCount"),
    )
    return o.select(k.alias("id"), kind.alias("event_type"), F.col("o_orderdate").alias("created_at"), F.to_json(details).alias("details"))


AUDIT = """audit as (select o_orderkey as id, kind as event_type, o_orderdate as created_at, case when kind = 'activation' then ['startup','default','temporal','cross_session'][o_orderkey % 4 + 1] end as mode,
 case when kind = 'activation' then o_custkey % 7 end as activated, case when kind = 'activation' and o_orderkey % 3 = 0 then o_orderkey % 2 = 0 end as pack, case when kind = 'session_summary_skipped' and o_orderkey % 2 = 0 then 'recent' end as reason,
 case when kind = 'auto_promotion_cycle' then o_orderkey % 3 end as promoted, case when kind = 'auto_promotion_cycle' then o_orderkey % 5 end as expired, case when kind = 'review_digest_shown' and o_orderkey % 2 = 1 then o_orderkey % 9 end as candidates
 from (select *, case o_orderpriority when '1-URGENT' then 'activation' when '2-HIGH' then 'session_summary_generated' when '3-MEDIUM' then 'session_summary_skipped' when '4-NOT SPECIFIED' then 'auto_promotion_cycle' else 'review_digest_shown' end as kind from orders))"""


def placed(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """``limit`` rows of an ordered list after ``offset``, with their ``place``."""
    some = rows.orderBy(*order).limit(limit + offset)
    return some.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") > offset)  # limit + offset rows


# ---- lists ---------------------------------------------------------------------------------------------------------


@query(f"with {M} select id, status, type, row_number() over (order by created_at desc, id)::int as place from memories where status in ('active','candidate') qualify place > 40 and place <= 60")
def memory_page(spark, sf):
    """A page of memories, latest first."""
    m = src.memories(spark, sf).where(F.col("status").isin("active", "candidate"))
    return placed(m, [F.desc("created_at"), F.asc("id")], 20, 40).select("id", "status", "type", "place")


@query(f"with {E} select id, session_id, row_number() over (order by created_at, id)::int as place from evidence where status in ('pending','latent') and created_at > timestamp '2024-01-10' qualify place <= 50")
def evidence_page(spark, sf):
    e = src.evidence(spark, sf).where(F.col("status").isin("pending", "latent") & (F.col("created_at") > F.lit("2024-01-10").cast(STAMP)))
    return placed(e, [F.asc("created_at"), F.asc("id")], 50).select("id", "session_id", "place")


@query(f"with {E} select id, row_number() over (order by created_at, id)::int as place from evidence where status in ('pending','retained') qualify place <= 50")
def processable_page(spark, sf):
    return placed(src.evidence(spark, sf).where(F.col("status").isin("pending", "retained")), [F.asc("created_at"), F.asc("id")], 50).select("id", "place")


@query(f"with {M} select id, len(embedding)::int as dims, label from memories join embeddings on vec_id = seq where embedding is not null")
def memories_with_vectors(spark, sf):
    e = src.read(spark, sf, "embeddings").where("embedding is not null")
    return src.memories(spark, sf).select("id", "seq").join(e, F.col("seq") == F.col("vec_id")).select("id", F.size("embedding").alias("dims"), "label")


@query(f"with {LINKS} select memory_id, event_id, row_number() over (order by created_at desc, event_id desc)::int as place from links where run_id >= '20240115' qualify place <= 100")
def links_page(spark, sf):
    return placed(links(spark, sf).where("run_id >= '20240115'"), [F.desc("created_at"), F.desc("event_id")], 100).select("memory_id", "event_id", "place")


@query(f"with {LINKS} select run_id, min(created_at) as started_at, count(*) as n_links, count(distinct memory_id) as n_memories from links group by run_id order by started_at desc limit 10")
def runs_page(spark, sf):
    g = links(spark, sf).groupBy("run_id").agg(F.min("created_at").alias("started_at"), F.count("*").alias("n_links"), F.count_distinct("memory_id").alias("n_memories"))
    return g.orderBy(F.desc("started_at")).limit(10)


@query(f"with {LINKS} select arg_max(run_id, created_at) as run_id, max(created_at) as last_at from links")
def latest_run(spark, sf):
    return links(spark, sf).agg(F.max_by("run_id", "created_at").alias("run_id"), F.max("created_at").alias("last_at"))


RULES_SQL = "rules(rule_code, trigger_kind, memory_id) as (values " + ", ".join(f"('{a}', '{b}', {repr(c) if c else 'null'})" for a, b, c in RULES) + ")"


@query(f"with {M}, {RULES_SQL} select rule_code, trigger_kind from rules r where trigger_kind in ('before_tool','session_start','before_model') and (memory_id is null or exists (select 1 from memories m where m.id = r.memory_id and m.status = 'active'))")
def live_policy_rules(spark, sf):
    """Rules that belong to no memory or to an active one."""
    rules = spark.createDataFrame(list(RULES), "rule_code string, trigger_kind string, memory_id string")
    live = src.memories(spark, sf).where("status = 'active'").select(F.col("id").alias("memory_id"))
    return rules.where("memory_id is null").unionByName(rules.join(live, "memory_id", "left_semi")).select("rule_code", "trigger_kind")


@query(f"with {AUDIT} select id, event_type, row_number() over (order by created_at desc, id desc)::int as place from audit where event_type in ('activation','auto_promotion_cycle') qualify place <= 50")
def audit_page(spark, sf):
    return placed(audit(spark, sf).where(F.col("event_type").isin("activation", "auto_promotion_cycle")), [F.desc("created_at"), F.desc("id")], 50).select("id", "event_type", "place")


@query(f"with {M} select id, row_number() over (order by last_verified_at asc nulls first, confidence, id)::int as place from memories where status = 'active' and (last_verified_at is null or last_verified_at < timestamp '{AS_OF}' - interval 7 day or confidence < 7e-1) qualify place <= 100")
def at_risk_page(spark, sf):
    """At-risk memories in the order in which they are reconciled: never verified first."""
    old = F.col("last_verified_at") < F.lit(AS_OF).cast(STAMP) - F.expr("interval 7 days")
    rows = src.memories(spark, sf).where("status = 'active'").where(F.col("last_verified_at").isNull() | old | (F.col("confidence") < 0.7))
    return placed(rows, [F.asc_nulls_first("last_verified_at"), F.asc("confidence"), F.asc("id")], 100).select("id", "place")


# ---- joins ---------------------------------------------------------------------------------------------------------


@query(f"with {E}, {LINKS} select memory_id, count(*) as n, count(distinct e.session_id) as n_sessions, min(e.created_at) as first_at, max(e.created_at) as last_at from links l join evidence e on e.id = l.event_id group by memory_id")
def links_by_memory(spark, sf):
    e = src.evidence(spark, sf).select(F.col("id").alias("event_id"), "session_id", F.col("created_at").alias("at"))
    g = links(spark, sf).join(e, "event_id").groupBy("memory_id")
    return g.agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("n_sessions"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


@query(f"with {E}, {LINKS} select run_id, e.tool, count(*) as n from links l join evidence e on e.id = l.event_id group by all")
def links_by_run(spark, sf):
    e = src.evidence(spark, sf).select(F.col("id").alias("event_id"), "tool")
    return links(spark, sf).join(e, "event_id").groupBy("run_id", "tool").agg(F.count("*").alias("n"))


@query(f"with {M}, {E}, {LINKS} select e.id from evidence e where e.id in (select event_id from links join memories m on m.id = memory_id where m.type = 'policy' and m.status = 'active')")
def evidence_of_policies(spark, sf):
    """Evidence whose id is in the list of links of active policies."""
    policies = src.memories(spark, sf).where("type = 'policy' and status = 'active'").select(F.col("id").alias("memory_id"))
    wanted = links(spark, sf).join(policies, "memory_id", "left_semi").select(F.col("event_id").alias("id"))
    return src.evidence(spark, sf).select("id").join(wanted, "id", "left_semi")


@query(f"""with {COS}, a as (select query_id, id, score from cos qualify row_number() over (partition by query_id order by round(score, 9) desc, id) <= 20),
b as (select query_id, id - 7 as id, score from cos where id >= 7 qualify row_number() over (partition by query_id order by round(score, 9) desc, id) <= 20)
select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.id, b.id) as id, round(greatest(coalesce(a.score, b.score), coalesce(b.score, a.score)), 6) as score from a full join b on a.query_id = b.query_id and a.id = b.id""")
def two_index_merge(spark, sf):
    """Two dense indexes merged by id, the greater score taken; the second index holds the vector seven places on."""
    e = src.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vec")
    a = retrieval.cosine_topk(q, e, 20).select("query_id", "id", F.col("score").alias("a"))
    b = retrieval.cosine_topk(q, e.where("id >= 7"), 20).select("query_id", (F.col("id") - 7).alias("id"), F.col("score").alias("b"))
    return a.join(b, ["query_id", "id"], "full_outer").select("query_id", "id", F.round(F.greatest("a", "b"), 6).alias("score"))


# ---- writes --------------------------------------------------------------------------------------------------------


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``new`` whose key ``old`` has not, once each: what an insert that ignores conflicts appends."""
    return new.dropDuplicates(key).join(old.select(*key), key, "left_anti")


@query(f"with {LINKS}, old as (select * from links where event_id % 2 = 0) select memory_id, event_id from links l where event_id % 3 = 0 and not exists (select 1 from old o where o.memory_id = l.memory_id and o.event_id = l.event_id)")
def insert_or_ignore_links(spark, sf):
    both = links(spark, sf)
    return insert_missing(both.where("event_id % 2 = 0"), both.where("event_id % 3 = 0").select("memory_id", "event_id"), ["memory_id", "event_id"])


def merge_fields(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the non-null fields of ``new`` (key and some of its columns) in place of its own."""
    fields = [c for c in new.columns if c != key]
    patch = new.select(key, *(F.col(c).alias(f"new {c}") for c in fields))
    out = old.join(patch, key, "left")
    return out.select(*(F.coalesce(f"new {c}", c).alias(c) if c in fields else c for c in old.columns))


@query(f"""with {M}, patch as (select 'm' || lpad(doc_id::varchar, 12, '0') as id, case when quality = 1 then 9e-1 end as confidence, case when toxic = 1 then 'withheld' end as details from labels),
upd as (select m.id, type, summary, coalesce(p.details, m.details) as details, scope_glob, triggers, coalesce(p.confidence, m.confidence) as confidence from memories m left join patch p using (id)), h as (select id, confidence, {IDENTITY_SQL} as identity_key from upd)
select id, round(confidence, 6) as confidence, identity_key, count(*) over (partition by identity_key) > 1 as is_duplicate from h""")
def update_memories(spark, sf):
    """A partial update: given fields replace the old ones, the identity follows, and rows that became equal are marked."""
    labels = src.read(spark, sf, "labels")
    patch = labels.select(F.concat(F.lit("m"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("id"), F.when(F.col("quality") == 1, 0.9).alias("confidence"), F.when(F.col("toxic") == 1, "withheld").alias("details"))
    rows = merge_fields(src.memories(spark, sf).select("id", "type", "summary", "details", "scope_glob", "triggers", "confidence"), patch, "id").select("id", F.round("confidence", 6).alias("confidence"), lifecycle.identity_key().alias("identity_key"))
    twice = rows.groupBy("identity_key").agg((F.count("*") > 1).alias("is_duplicate"))
    return rows.join(twice, "identity_key").select("id", "confidence", "identity_key", "is_duplicate")


@query("with patch as (select vec_id, list_reverse(embedding) as embedding from embeddings where vec_id % 4 = 0) select e.vec_id, round(coalesce(p.embedding, e.embedding)[1]::double, 6) as first, p.vec_id is not null as changed from embeddings e left join patch p using (vec_id)")
def update_vectors(spark, sf):
    e = src.read(spark, sf, "embeddings").select("vec_id", "embedding")
    patch = e.where("vec_id % 4 = 0").select("vec_id", F.reverse("embedding").alias("embedding"))
    out = merge_fields(e, patch, "vec_id").join(patch.select("vec_id", F.lit(True).alias("changed")), "vec_id", "left")
    return out.select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.coalesce("changed", F.lit(False)).alias("changed"))


@query(f"with {M}, tiers as (select *, 'global' as tier from memories where seq % 2 = 0 union all select *, 'project' from memories where seq % 3 = 0) select id, max(tier) as preferred, count(*) as n, min(case tier when 'global' then 0 else 1 end)::int as first_place from tiers group by id")
def tier_merge(spark, sf):
    """Memories of two tiers, the global one listed first; a lookup by id prefers the project's."""
    m = src.memories(spark, sf)
    both = m.where("seq % 2 = 0").select("id", F.lit("global").alias("tier"), F.lit(0).alias("place")).unionByName(m.where("seq % 3 = 0").select("id", F.lit("project").alias("tier"), F.lit(1).alias("place")))
    return both.groupBy("id").agg(F.max("tier").alias("preferred"), F.count("*").alias("n"), F.min("place").alias("first_place"))


# ---- predicates and windows ----------------------------------------------------------------------------------------


@query(f"with {E} select id from evidence where trim(excerpt) = '' or length(excerpt) < 20")
def adapter_noise(spark, sf):
    """Events that the adapter drops at once: blank or under 20 characters."""
    return src.evidence(spark, sf).where((F.trim("excerpt") == "") | (F.length("excerpt") < 20)).select("id")


@query(f"with {M} select id from memories where status = 'active' and promotion_source = 'auto' and validation_count = 0 and updated_at > timestamp '2024-01-31' - interval 24 hour")
def recent_auto_promotions(spark, sf):
    day = F.lit("2024-01-31").cast(STAMP) - F.expr("interval 24 hours")
    return src.memories(spark, sf).where("status = 'active' and promotion_source = 'auto' and validation_count = 0").where(F.col("updated_at") > day).select("id")


@query(f"with {E} select id, (row_number() over (partition by session_id order by created_at, id) % 10 = 0) as boosted from evidence")
def tenth_call_boost(spark, sf):
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "id"))
    return src.evidence(spark, sf).select("id", (n % 10 == 0).alias("boosted"))


@query(r"""select conv_id, turn, case when row_number() over (partition by conv_id order by turn) = 1 then 'startup' when regexp_matches(text, '(?i)\b(when|changed|before|after|history|evolution|switched|timeline)\b') then 'temporal' when regexp_matches(text, '(?i)\b(across sessions?|different sessions?|always|every time|consistently)\b') then 'cross_session' else 'default' end as mode from conversations where text is not null""")
def call_modes(spark, sf):
    """The first call of a session starts up; later ones are routed by their text."""
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) == 1
    return src.read(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", F.when(first, "startup").otherwise(text.query_mode(F.col("text"))).alias("mode"))


@query(r"""select conv_id, turn, case when regexp_matches(text, '(?i)\b(across sessions?|different sessions?|always|every time|consistently)\b') then 'cross_session' when regexp_matches(text, '(?i)\b(when|changed|before|after|history|evolution|switched|timeline)\b') then 'temporal' else 'default' end as mode from conversations where text is not null""")
def query_router_eval(spark, sf):
    """The router of the evaluation, which looks for cross-session words first."""
    t = src.read(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", "text")
    cross = text.router_hit(F.col("text"), "cross_session")
    return t.select("conv_id", "turn", F.when(cross, "cross_session").when(text.router_hit(F.col("text"), "temporal"), "temporal").otherwise("default").alias("mode"))


@query(r"select conv_id, turn, len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\r\f\v]+'), lambda x: length(x) > 2 and length(x) < 50))::int as n_tokens from conversations")
def query_tokens(spark, sf):
    t = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\r\f\x0B]+"), lambda x: (F.length(x) > 2) & (F.length(x) < 50))
    return src.read(spark, sf, "conversations").select("conv_id", "turn", F.size(t).alias("n_tokens"))


@query(f"with {M} (select scope_glob from memories where status = 'active' except select scope_glob from memories where status = 'stale' and type = 'policy') union all (select scope_glob || '!' from memories where type = 'decision' intersect select scope_glob || '!' from memories where status = 'candidate')")
def scope_sets(spark, sf):
    """Scopes of active memories without those of stale policies; and, marked, those that decisions and candidates have in common."""
    m = src.memories(spark, sf).select("scope_glob", "status", "type")
    left = m.where("status = 'active'").select("scope_glob").subtract(m.where("status = 'stale' and type = 'policy'").select("scope_glob"))
    both = m.where("type = 'decision'").select("scope_glob").intersect(m.where("status = 'candidate'").select("scope_glob"))
    return left.unionByName(both.select(F.concat("scope_glob", F.lit("!")).alias("scope_glob")))


# ---- health --------------------------------------------------------------------------------------------------------


@query(f"with {M} select b as bucket, count(id) as n from (select unnest(['active','candidate','inactive','stale','rejected']) as b) left join memories on b = case status when 'superseded' then 'inactive' else status end group by b")
def status_buckets(spark, sf):
    """Counts of all buckets, superseded memories counting as inactive."""
    names = spark.createDataFrame([(x,) for x in ("active", "candidate", "inactive", "stale", "rejected")], "bucket string")
    m = src.memories(spark, sf).groupBy(F.when(F.col("status") == "superseded", "inactive").otherwise(F.col("status")).alias("bucket")).agg(F.count("*").alias("n"))
    return names.join(m, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"with {E}, {LINKS} select count(distinct l.event_id) filter (e.status = 'retained') as materialized, count(*) filter (e.status <> 'discarded') as kept, round(count(distinct l.event_id) filter (e.status = 'retained') / nullif(count(*) filter (e.status <> 'discarded'), 0)::double, 6) as rate from evidence e left join links l on l.event_id = e.id")
def materialization_rate(spark, sf):
    e = src.evidence(spark, sf).select(F.col("id").alias("event_id"), "status").join(links(spark, sf).select("event_id", F.lit(1).alias("linked")), "event_id", "left")
    done, kept = F.count_distinct(F.when((F.col("status") == "retained") & (F.col("linked") == 1), F.col("event_id"))), F.count(F.when(F.col("status") != "discarded", 1))
    return e.agg(done.alias("materialized"), kept.alias("kept"), F.round(F.try_divide(done, kept), 6).alias("rate"))


LAST50 = "last50 as (select * from audit where event_type = 'activation' order by created_at desc, id desc limit 50)"


@query(f"with {AUDIT}, {LAST50} select m as mode, count(id) as n, (select round(avg(coalesce(activated, 0)), 6) from last50) as mean_activated, (select round(count(*) filter (pack) / nullif(count(*) filter (mode = 'startup'), 0)::double, 6) from last50) as startup_rate from (select unnest(['startup','default','temporal','cross_session']) as m) left join last50 on mode = m group by m")
def activation_modes_last50(spark, sf):
    """Modes of the last 50 activations, the mean number of memories, and the rate of startup packs."""
    last = audit(spark, sf).where("event_type = 'activation'").orderBy(F.desc("created_at"), F.desc("id")).limit(50)
    d = last.select("id", F.from_json("details", "activationMode string, activatedCount long, startupPackInjected boolean").alias("d")).select("id", "d.*")
    total = d.agg(F.round(F.avg(F.coalesce("activatedCount", F.lit(0))), 6).alias("mean_activated"), F.round(F.try_divide(F.count(F.when(F.col("startupPackInjected"), 1)), F.count(F.when(F.col("activationMode") == "startup", 1))), 6).alias("startup_rate"))
    names = spark.createDataFrame([(x,) for x in MODES], "mode string")
    counts = d.groupBy(F.col("activationMode").alias("mode")).agg(F.count("*").alias("n"))
    return names.join(counts, "mode", "left").select("mode", F.coalesce("n", F.lit(0)).alias("n")).crossJoin(total)


@query(f"with {AUDIT} select sum(promoted)::bigint as promoted, sum(expired)::bigint as expired, count(*) as cycles from audit where event_type = 'auto_promotion_cycle' and created_at >= (select max(created_at) from audit) - interval 7 day")
def promotion_cycles_7d(spark, sf):
    """Promotions and expiries in the last seven days of the log."""
    a = audit(spark, sf)
    since = a.agg((F.max("created_at") - F.expr("interval 7 days")).alias("since"))  # one row
    rows = a.where("event_type = 'auto_promotion_cycle'").crossJoin(F.broadcast(since)).where("created_at >= since")
    d = rows.select(F.from_json("details", "promotedCount long, expiredCount long").alias("d"))
    return d.agg(F.sum("d.promotedCount").alias("promoted"), F.sum("d.expiredCount").alias("expired"), F.count("*").alias("cycles"))


def metric_presence(rows: DataFrame) -> DataFrame:
    """(metric, event_count) of the metrics that audit rows may report."""
    d = rows.select("event_type", F.from_json("details", "activationMode string, activatedCount long, startupPackInjected boolean, reason string, promotedCount long, candidateCount long").alias("d"))
    given = {
        "activation_mode": F.col("d.activationMode").isNotNull(), "activated_count": F.col("d.activatedCount").isNotNull(), "startup_pack_injected": F.col("d.startupPackInjected").isNotNull(),
        "session_summary_generated": F.col("event_type") == "session_summary_generated", "summary_generation_skipped_reason": F.col("d.reason").isNotNull(), "auto_promoted_count": F.col("d.promotedCount").isNotNull(),
        "review_digest_shown": F.col("event_type") == "review_digest_shown", "candidate_count": F.col("d.candidateCount").isNotNull(), "dream_actions": F.col("event_type") == "extraction_action", "query_type": F.lit(False),
    }
    counted = d.agg(*(F.count(F.when(c, 1)).alias(k) for k, c in given.items()))
    return counted.unpivot([], list(given), "metric", "event_count")


PRESENCE = f"""{AUDIT}, pres as (select 'activation_mode' as metric, count(mode) as event_count from audit union all select 'activated_count', count(activated) from audit union all select 'startup_pack_injected', count(pack) from audit
 union all select 'session_summary_generated', count(*) filter (event_type = 'session_summary_generated') from audit union all select 'summary_generation_skipped_reason', count(reason) from audit union all select 'auto_promoted_count', count(promoted) from audit
 union all select 'review_digest_shown', count(*) filter (event_type = 'review_digest_shown') from audit union all select 'candidate_count', count(candidates) from audit union all select 'dream_actions', 0 union all select 'query_type', 0)"""


@query(f"with {PRESENCE} select * from pres")
def metric_presence_counts(spark, sf):
    return metric_presence(audit(spark, sf))


@query(f"with {PRESENCE} select case when (select count(*) from documents) + (select count(*) from events) + (select count(*) from audit) = 0 then 'no_data_yet' when (select count(*) from pres where event_count = 0) > 0 then 'needs_attention' else 'healthy' end as status")
def overall_status(spark, sf):
    """no_data_yet, needs_attention while a metric is missing, or healthy."""
    missing = metric_presence(audit(spark, sf)).agg(F.count(F.when(F.col("event_count") == 0, 1)).alias("missing"))
    some = src.read(spark, sf, "documents").select(F.lit(1).alias("x")).limit(1).unionByName(src.read(spark, sf, "events").select(F.lit(1).alias("x")).limit(1)).unionByName(audit(spark, sf).select(F.lit(1).alias("x")).limit(1)).agg(F.count("*").alias("n"))
    return missing.crossJoin(some).select(F.when(F.col("n") == 0, "no_data_yet").when(F.col("missing") > 0, "needs_attention").otherwise("healthy").alias("status"))


@query(f"with {M}, c as (select type, id, confidence, row_number() over (partition by type order by confidence desc, created_at, id) as k, count(*) over (partition by type) as n from memories where status = 'candidate') select type, n, string_agg(id, ',' order by k) as best from c where k <= 5 group by type, n")
def candidate_digest(spark, sf):
    """Candidates by type: how many, and the five most confident."""
    c = src.memories(spark, sf).where("status = 'candidate'").select("type", "id", "confidence", "created_at")
    k = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("confidence"), "created_at", "id"))
    best = c.withColumn("k", k).where("k <= 5").groupBy("type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]), ",").alias("best"))
    return c.groupBy("type").agg(F.count("*").alias("n")).join(best, "type")
