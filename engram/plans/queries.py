"""The library's queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import evidence as ev
from ..operators import changes, globs, index, lifecycle, reports, retrieval, scan, selection, similarity
from ..sources import adapters as src
from ..sources.store import Store

AS_OF = src.AS_OF
QUERIES: dict = {}
SQL: dict[str, str] = {}
M, E, R = src.MEMORIES_SQL, src.EVIDENCE_SQL, src.REQUESTS_SQL
AGE = f"greatest(0e0, (epoch_us(timestamp '{AS_OF}') - epoch_us(coalesce(last_verified_at, updated_at, created_at))) / 86400e6)"
SCORE = f"importance * confidence * greatest(75e-2, 1e0 - {AGE} * 1e-2) * case when promotion_source = 'manual' then 1e0 when validation_count = 0 then 65e-2 when validation_count = 1 then 8e-1 else 95e-2 end"
#: JSON of a memory's payload; to_json of a struct has the same bytes.
BYTES = "octet_length(encode(to_json(struct_pack(id := id, type := type, summary := summary, details := details, \"scopeGlob\" := scope_glob, \"lifecycleTriggers\" := triggers, status := status))::varchar))"
FITS = """list_contains(m.triggers, r.trigger) and case m.seq % 4 when 0 then true when 1 then starts_with(r.scope_ref, replace(m.scope_glob, '**', ''))
  when 2 then regexp_full_match(r.scope_ref, replace(replace(m.scope_glob, '.', '\\.'), '*', '[^/]*')) else starts_with(r.scope_ref, 'docs/') end"""
CAND = f"""cand as (select r.request_id, m.id, m.type, m.scope_glob, m.activation_class, m.importance, m.confidence, m.updated_at, m.created_at, {BYTES} as bytes,
  {SCORE} + case when r.trigger = 'before_tool' and m.relevant_tools is not null then 15e-2 else 0e0 end as score
  from memories m join requests r on {FITS} and (m.relevant_tools is null or coalesce(list_contains(m.relevant_tools, r.tool), false))
  where status = 'active' and not coalesce(ttl_expires_at < timestamp '{AS_OF}', false))"""
ORDER = "score desc, importance desc, confidence desc, updated_at desc, created_at desc, id"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- sources, gates and scores -------------------------------------------------------------------------------------


@query(f"with {M} select id, type, status, created_at from memories where status in ('active', 'candidate') and type in ('policy', 'decision')")
def memory_list_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return src.memories(spark, sf).where(F.col("status").isin("active", "candidate") & F.col("type").isin("policy", "decision")).select("id", "type", "status", "created_at")


@query(f"with {M} select s.status, count(m.id) as n from (select unnest(['active','candidate','superseded','stale','rejected']) as status) s left join memories m using (status) group by s.status")
def memory_stats_by_status(spark, sf):
    return reports.zero_filled(spark, src.memories(spark, sf).select("status"), "status", ("active", "candidate", "superseded", "stale", "rejected"))


@query(f"with {M} select type, count(*) as n, round(avg(confidence), 6) as mean_confidence, min(created_at) as first_at, max(created_at) as last_at from memories group by type")
def memory_stats_by_type(spark, sf):
    g = src.memories(spark, sf).groupBy("type")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@query(f"with {M} select id, round({SCORE}, 6) as score from memories")
def memory_score(spark, sf):
    return src.memories(spark, sf).select("id", F.round(scoring.memory_score(AS_OF), 6).alias("score"))


@query(f"with {M} select id, {BYTES}::int as bytes from memories")
def payload_bytes(spark, sf):
    return src.memories(spark, sf).select("id", scoring.payload_bytes().alias("bytes"))


@query(f"with {M} select id, case when status <> 'active' then 'status_inactive' when ttl_expires_at < timestamp '{AS_OF}' then 'ttl_expired' else 'kept' end as kind from memories")
def status_ttl_gate(spark, sf):
    return selection.gates(src.memories(spark, sf), AS_OF).select("id", F.coalesce("kind", F.lit("kept")).alias("kind"))


@query(f"with {M}, {R} select r.request_id, m.id from memories m join requests r on {FITS}")
def trigger_scope_gate(spark, sf):
    return globs.in_scope(src.memories(spark, sf).select("id", "triggers", "scope_glob"), src.requests(spark)).select("request_id", "id")


@query(f"with {M} select id, relevant_tools is null or list_contains(relevant_tools, 'bash') as for_bash, relevant_tools is null or list_contains(relevant_tools, 'edit') as for_edit from memories")
def tool_gate(spark, sf):
    ok = lambda t: F.col("relevant_tools").isNull() | F.coalesce(F.array_contains("relevant_tools", t), F.lit(False))
    return src.memories(spark, sf).select("id", ok("bash").alias("for_bash"), ok("edit").alias("for_edit"))


@query(f"""with {M} select id from memories where status = 'active' and (last_verified_at is null or last_verified_at < timestamp '{AS_OF}' - interval 7 day or confidence < 7e-1)""")
def at_risk_memories(spark, sf):
    old = F.col("last_verified_at") < F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 7 days")
    return src.memories(spark, sf).where("status = 'active'").where(F.col("last_verified_at").isNull() | old | (F.col("confidence") < 0.7)).select("id")


# ---- activation ----------------------------------------------------------------------------------------------------

FOLD = """numbered as (select *, row_number() over (partition by request_id order by {order}) as rn from {rows}),
fold as (select request_id, 0::bigint as rn, 0::bigint as used, []::varchar[] as ids, []::varchar[] as types, 0::bigint as last from (select distinct request_id from numbered)
  union all select f.request_id, n.rn, case when {ok} then f.used + n.bytes else f.used end, case when {ok} then list_append(f.ids, n.id) else f.ids end, case when {ok} then list_append(f.types, n.type) else f.types end, n.rn
  from fold f join numbered n on n.request_id = f.request_id and n.rn = f.rn + 1),
final as (select request_id, unnest(ids) as id, generate_subscripts(ids, 1)::int as rank from (select request_id, max_by(ids, rn) as ids from fold group by request_id))"""
FITS_BUDGET = "(len(f.ids) < 10 and f.used + n.bytes <= 8192)"


@query(f"with recursive {M}, {R}, {CAND}, {FOLD.format(order=ORDER, rows='cand', ok=FITS_BUDGET)} select request_id, id, rank from final")
def activate_default_scored(spark, sf):
    """Gates, score, total order and the greedy budget, for all requests."""
    return selection.select(selection.candidates(src.memories(spark, sf), src.requests(spark), AS_OF)).select("request_id", "id", "rank")


PENAL = f"""penal0 as (select *, split_part(scope_glob, '/', 1) as prefix, row_number() over (partition by request_id, split_part(scope_glob, '/', 1) order by {ORDER}) as place from cand),
penal as (select request_id, id, type, importance, confidence, updated_at, created_at, bytes, case when prefix <> '' and place > 1 then score * 7e-1 else score end as score from penal0)"""
FITS_QUOTA = "(len(f.ids) < 10 and f.used + n.bytes <= 8192 and len(list_filter(f.types, lambda x: x = n.type)) < case n.type when 'policy' then 3 when 'workflow' then 3 when 'pitfall' then 2 else 1 end)"


@query(f"with {M}, {R}, {CAND}, {PENAL} select request_id, id, round(score, 13) as score from penal")
def prefix_penalty(spark, sf):
    rows = selection.candidates(src.memories(spark, sf), src.requests(spark), AS_OF)
    return selection.penalise_prefix(rows).select("request_id", "id", F.round("score", 13).alias("score"))


@query(f"with recursive {M}, {R}, {CAND}, {PENAL}, {FOLD.format(order=ORDER, rows='penal', ok=FITS_QUOTA)} select request_id, id, rank from final")
def activate_with_quotas(spark, sf):
    rows = selection.penalise_prefix(selection.candidates(src.memories(spark, sf), src.requests(spark), AS_OF))
    return selection.select(rows, quotas=selection.QUOTAS).select("request_id", "id", "rank")


@query(f"with {M}, {R}, {CAND} select request_id, id, row_number() over (partition by request_id order by {ORDER})::int as rank from cand qualify rank <= 20")
def total_order_topk(spark, sf):
    rows = selection.candidates(src.memories(spark, sf), src.requests(spark), AS_OF)
    w = Window.partitionBy("request_id").orderBy(selection.sort_key())
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("request_id", "id", "rank")


ROUND = """r0 as (select *, row_number() over (partition by request_id order by {o}) as pos from cand), r1 as (select *, row_number() over (partition by request_id, scope_glob order by pos) as rn, min(pos) over (partition by request_id, scope_glob) as f from r0)"""


@query(f"with {M}, {R}, {CAND}, {ROUND.format(o=ORDER)} select request_id, id, row_number() over (partition by request_id order by rn, f)::int as rank from r1 where rn <= 2")
def diversify(spark, sf):
    """At most two rows of each scope, round-robin."""
    rows = selection.candidates(src.memories(spark, sf), src.requests(spark), AS_OF)
    return selection.interleave(rows, "scope_glob", [selection.sort_key()], cap=2).select("request_id", "id", "rank")


@query(f"with {M}, {R}, {CAND}, {ROUND.format(o=ORDER)} select request_id, id, row_number() over (partition by request_id order by rn, f)::int as rank from r1")
def interleave(spark, sf):
    rows = selection.candidates(src.memories(spark, sf), src.requests(spark), AS_OF)
    return selection.interleave(rows, "scope_glob", [selection.sort_key()]).select("request_id", "id", "rank")


@query(f"with recursive {M}, {R}, {CAND}, {FOLD.format(order=ORDER, rows='cand', ok=FITS_BUDGET)} select request_id, final.id, case when activation_class = 'baseline' or rank <= 5 then 'full' when rank <= 8 then 'summary' else 'hint' end as tier from final join memories using (id)")
def disclosure_tiers(spark, sf):
    m = src.memories(spark, sf)
    chosen = selection.select(selection.candidates(m, src.requests(spark), AS_OF))
    return m.select("id", "activation_class").join(chosen, "id").select("request_id", "id", selection.disclosure(F.col("rank"), F.col("activation_class")).alias("tier"))


@query(f"with {M} select type, scope_glob, array_to_string(triggers, ',') as triggers, count(*) as n, arg_min(id, (created_at, id)) as root_id from memories where status = 'active' group by all having count(*) > 1")
def conflict_groups(spark, sf):
    return selection.conflicts(src.memories(spark, sf))


@query(f"with {M}, {R} select request_id, m.id as rule_code from memories m join requests r on {FITS.replace('list_contains(m.triggers, r.trigger)', 'm.triggers[1] = r.trigger')} where type = 'policy' and status = 'active'")
def policy_warnings(spark, sf):
    """Active policies as rules, each with its first trigger."""
    rules = src.memories(spark, sf).where("type = 'policy' and status = 'active'").select(F.col("id").alias("rule_code"), F.col("triggers")[0].alias("trigger_kind"), F.col("scope_glob").alias("rule_glob"))
    return selection.policy_warnings(rules, src.requests(spark))


# ---- retrieval -----------------------------------------------------------------------------------------------------

VEC = "q as (select vec_id as query_id, embedding as vec from embeddings where vec_id % 20 = 0), v as (select vec_id as id, embedding as vec, label from embeddings)"
COS = f"{VEC}, cos as (select query_id, id, label, list_sum(list_transform(generate_series(1, len(v.vec)), lambda i: v.vec[i]::double * q.vec[i]::double)) as score from q join v on q.query_id <> v.id)"
TOP = f"{COS}, top as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id)::int as rank from cos)"


def _vectors(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = src.read(spark, sf, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query(f"with {TOP} select query_id, id, round(score, 6) as score, rank from top where rank <= 10")
def cosine_topk(spark, sf):
    return retrieval.cosine_topk(*_vectors(spark, sf), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"with {TOP} select query_id, id, round(score, 6) as score, rank from top where rank <= 10")
def cosine_topk_pruned(spark, sf):
    """The same by groups around centroids, of which each query visits those whose bound allows a better vector."""
    return retrieval.cosine_topk(*_vectors(spark, sf), 10, groups=32).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"with {TOP} select query_id, id as nearest_id, score > 85e-2 as is_duplicate from top where rank = 1")
def near_dup_gate(spark, sf):
    """Whether a new vector is a near duplicate: its nearest other vector has a cosine above 0.85."""
    return retrieval.cosine_topk(*_vectors(spark, sf), 1).select("query_id", F.col("id").alias("nearest_id"), (F.col("score") > 0.85).alias("is_duplicate"))


LEX = r"""toks as (select id, f, string_split_regex(lower(regexp_replace(regexp_replace(t, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[\s\pP]+') as raw from (select id, 's' as f, summary as t from memories union all select id, 'd', details from memories)),
tok as (select id, f, list_filter(raw, lambda x: x <> '') as t from toks),
qtok as (select item_id as query_id, unnest(list_distinct(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[\s\pP]+'), lambda x: x <> ''))) as term from benchmark where item_id % 20 = 0)"""


def all_memories(spark, sf: str) -> Store:
    """The stored index of all memories."""
    return index.shared(spark, sf, "all", lambda: src.memories(spark, sf).select("id", "summary", "details"))


def _lexical_queries(spark, sf) -> DataFrame:
    return src.read(spark, sf, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"""with {M}, {LEX}, mean as (select f, avg(len(t)) as m from tok group by f), tf as (select id, f, len(t) as n, term, count(*) as tf from (select id, f, t, unnest(t) as term from tok) group by all),
df as (select f, term, count(*) as df from tf group by all),
w as (select query_id, id, ln(1e0 + ((select count(*) from memories) - df + 5e-1) / (df + 5e-1)) * tf * 22e-1 / (tf + 12e-1 * (25e-2 + n * 75e-2 / m)) * case f when 's' then 25e-1 else 1e0 end as w from tf join df using (f, term) join mean using (f) join qtok using (term)),
s as (select query_id, id, round(sum(w), 6) as score from w group by all) select query_id, id, round(score, 4) as score, row_number() over (partition by query_id order by score desc, id)::int as rank from s qualify rank <= 10""")
def bm25_topk(spark, sf):
    """Words of the queries looked up in the stored index of all memories."""
    scored = index.search(all_memories(spark, sf), _lexical_queries(spark, sf).withColumnRenamed("query_id", "request_id"), prefixes=False, save=src.checkpointed)
    return retrieval.best(scored.withColumnRenamed("request_id", "query_id"), 10).withColumn("score", F.round("score", 4))


@query(f"""with {TOP}, a as (select query_id, id, rank from top where rank <= 20), b as (select query_id, id, row_number() over (partition by query_id order by id desc)::int as rank from top where rank <= 30 qualify row_number() over (partition by query_id order by id desc) <= 20),
s as (select query_id, id, sum(1e0 / (60 + rank)) as score, count(*) as sources from (select * from a union all select * from b) group by all)
select query_id, id, round(score, 6) as score, sources, row_number() over (partition by query_id order by round(score, 9) desc, id)::int as rank from s""")
def rrf_fusion(spark, sf):
    top = retrieval.cosine_topk(*_vectors(spark, sf), 30)
    recent = top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("id")))).where("rank <= 20")
    return retrieval.rrf([top.where("rank <= 20"), recent]).withColumn("score", F.round("score", 6))


@query(f"""with {TOP}, rel as (select a.vec_id as query_id, b.vec_id as id from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
n as (select query_id, count(*) as n from rel group by all), h as (select t.query_id, rank, r.id is not null as hit from top t left join rel r on r.query_id = t.query_id and r.id = t.id where rank <= 5)
select query_id, round(count(*) filter (hit) / 5e0, 6) as "precision", round(case when any_value(n) is null then 1e0 else count(*) filter (hit) / any_value(n)::double end, 6) as recall, round(max(case when hit then 1e0 / rank else 0e0 end), 6) as rr,
 round(case when any_value(n) is null then 0e0 else sum(case when hit then 1e0 / log2(rank + 1) else 0e0 end) / list_sum(list_transform(generate_series(1, greatest(1, least(5, any_value(n)))), lambda i: 1e0 / log2(i + 1))) end, 6) as ndcg from h left join n using (query_id) group by query_id""")
def ir_metrics(spark, sf):
    e = src.read(spark, sf, "embeddings")
    a = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    relevant = a.join(e.select(F.col("vec_id").alias("id"), "label"), "label").where("query_id != id").select("query_id", "id")
    m = retrieval.ir_metrics(retrieval.cosine_topk(*_vectors(spark, sf), 5), relevant)
    return m.select("query_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "rr", "ndcg")))


@query(f"with {M}, {LEX} select id, len(t)::bigint as n_tokens, len(list_distinct(t))::bigint as n_distinct from tok where f = 'd'")
def tokenizer_counts(spark, sf):
    t = src.memories(spark, sf).select("id", text.code_tokens(F.col("details")).alias("t"))
    return t.select("id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(r"""select conv_id, turn, case when regexp_matches(text, '(?i)\b(when|changed|before|after|history|evolution|switched|timeline)\b') then 'temporal' when regexp_matches(text, '(?i)\b(across sessions?|different sessions?|always|every time|consistently)\b') then 'cross_session' else 'default' end as mode from conversations where text is not null""")
def query_router(spark, sf):
    return src.read(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", text.query_mode(F.col("text")).alias("mode"))


@query(f"""with {COS} select label, round(avg(x), 6) as mean, round(median(x), 6) as median, round(stddev_pop(x), 6) as stddev, round(min(x), 6) as least, round(max(x), 6) as most, count(*) as n from (select label, round(score, 9) as x from cos) group by label""")
def similarity_distribution(spark, sf):
    """How similar the queries are to the vectors of each label."""
    vectors = src.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))
    return similarity.distribution(_vectors(spark, sf)[0], vectors, src.checkpointed)


# ---- evidence ------------------------------------------------------------------------------------------------------

TAG_SQL = "list_filter([" + ", ".join(f"case when regexp_matches({'excerpt' if f == 'excerpt' else 'lower(args_json)'}, '(?i){p}') then '{t}' end" for t, p, f in text.SIGNALS) + "], lambda x: x is not null)"
TYPE_SQL = "case " + " ".join(f"when regexp_matches(lower(title || ' ' || excerpt), '{p}') then '{k}'" for k, p in text.TYPE_LADDER) + " else 'workflow' end"


@query(f"with {E} select id, array_to_string({TAG_SQL}, ',') as tags from evidence")
def signal_tags(spark, sf):
    return ev.enriched(src.evidence(spark, sf)).select("id", F.array_join("tags", ",").alias("tags"))


@query(f"""with recursive {M}, {E}, requests as (select dense_rank() over (order by scope_ref, tool) as request_id, 'before_tool' as trigger, scope_ref, tool, '' as query from (select distinct scope_ref, tool from evidence)), {CAND}, {FOLD.format(order=ORDER, rows='cand', ok=FITS_BUDGET)},
rel as (select request_id, count(*) as related from final group by 1), con as (select request_id, count(*) as conflicts from (select request_id from final join memories using (id) group by request_id, type, scope_glob, triggers having count(*) > 1) group by 1),
t as (select e.*, {TYPE_SQL} as type, coalesce(related, 0) as related, coalesce(conflicts, 0) as conflicts from evidence e join requests using (scope_ref, tool) left join rel using (request_id) left join con using (request_id))
select id, type, related, conflicts, round(least(1e0, 45e-2 + case when type = 'pitfall' then 25e-2 when type in ('policy','decision') then 15e-2 when type = 'architecture_constraint' then 1e-1 else 0e0 end + case when related > 0 then 1e-1 else 0e0 end + case when conflicts > 0 then 1e-1 else 0e0 end
 + case when regexp_matches(title || ' ' || excerpt, '(?i){text.SUCCESS}') then 1e-1 else 0e0 end + case when tool = 'bash' then 5e-2 else 0e0 end), 6) as salience,
 round(least(1e0, case when related = 0 then 8e-1 else 55e-2 end + case when type in ('decision','architecture_constraint') then 1e-1 else 0e0 end + case when conflicts > 0 then 1e-1 else 0e0 end), 6) as novelty from t""")
def type_salience_novelty(spark, sf):
    """Salience and novelty with the memories that an activation gives for the event's scope and tool, and the conflicts among these."""
    e = src.evidence(spark, sf)
    context = ev.context_counts(e, src.memories(spark, sf), AS_OF)
    return ev.enriched(e, context).select("id", "type", "related", "conflicts", F.round("salience", 6).alias("salience"), F.round("novelty", 6).alias("novelty"))


@query(f"with {E} select count(*) filter (trim(excerpt) = '') as blank_excerpts, count(*) filter (trim(title) = '' and trim(excerpt) = '' and trim(args_json) = '') as noise from evidence")
def noise_filter(spark, sf):
    return src.evidence(spark, sf).agg(F.count(F.when(F.trim("excerpt") == "", 1)).alias("blank_excerpts"), F.count(F.when(ev.noise(), 1)).alias("noise"))


@query(f"with {E} select id from evidence where status in ('pending', 'retained')")
def processable_events(spark, sf):
    return src.evidence(spark, sf).where(F.col("status").isin("pending", "retained")).select("id")


@query(f"with {E} select id from evidence where status = 'latent' and created_at < timestamp '{AS_OF}' - interval 14 day")
def latent_expired(spark, sf):
    return src.evidence(spark, sf).where((F.col("status") == "latent") & (F.col("created_at") < F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 14 days"))).select("id")


GROUPS = "g as (select session_id, scope_ref, tool, min(created_at) as first_at, max(created_at) as last_at, count(*) as n_events from evidence group by all)"
ISLANDS = f"""{GROUPS}, i0 as (select *, max(last_at) over (partition by session_id, scope_ref order by first_at, last_at, tool rows between unbounded preceding and 1 preceding) as b from g),
isl as (select *, sum(case when b is null or first_at >= b + interval 5 minute then 1 else 0 end) over (partition by session_id, scope_ref order by first_at, last_at, tool)::int as island from i0)"""
MERGED = f"""{ISLANDS}, ev as (select e.*, island, {TAG_SQL} as tags from evidence e join isl using (session_id, scope_ref, tool)),
mg as (select session_id, scope_ref, island, count(*) as n, list_sort(list_distinct(flatten(list(tags)))) as tags, min(created_at) as first_at, arg_min(id, (created_at, id)) as lead_id from ev group by all),
tiered as (select *, case when n >= 3 then 1 when list_contains(tags, 'failure_signal') and list_contains(tags, 'has_file_context') then 1 when n >= 2 then 2 when len(tags) > 0 then 2 else 3 end as tier from mg)"""


@query(f"with {E}, {GROUPS} select * from g")
def structural_groups(spark, sf):
    return ev.structural_groups(src.evidence(spark, sf))


@query(f"with {E}, {ISLANDS} select session_id, scope_ref, tool, island from isl")
def time_adjacent_islands(spark, sf):
    return ev.islands(src.evidence(spark, sf)).select("session_id", "scope_ref", "tool", "island")


@query(f"""with {E}, {MERGED} select session_id, scope_ref, island, n as n_events, array_to_string(tags, ',') as tags, lead_id, tier::int as tier,
 round(case tier when 1 then least(95e-2, 8e-1 + n * 2e-2) when 2 then least(85e-2, 6e-1 + n * 5e-2) else 4e-1 end, 6) as confidence,
 round(least(95e-2, 4e-1 + case when list_contains(tags,'failure_signal') then 15e-2 else 0e0 end + case when list_contains(tags,'decision_signal') then 1e-1 else 0e0 end + case when list_contains(tags,'architecture_signal') then 1e-1 else 0e0 end + case when list_contains(tags,'convention_signal') then 5e-2 else 0e0 end + least(2e-1, (n - 1) * 1e-1)), 6) as importance from tiered""")
def group_confidence_importance(spark, sf):
    g = ev.merged_groups(src.evidence(spark, sf))
    return g.select("session_id", "scope_ref", "island", "n_events", F.array_join("tags", ",").alias("tags"), "lead_id", "tier", F.round("confidence", 6).alias("confidence"), F.round("importance", 6).alias("importance"))


@query(f"with {E}, {MERGED} select tier::int as tier, count(*) as n from tiered group by tier")
def tier_distribution(spark, sf):
    return ev.merged_groups(src.evidence(spark, sf)).groupBy("tier").agg(F.count("*").alias("n"))


@query(f"with {E}, {MERGED} select case when tier = 3 then 'latent' else 'materialized' end as action, sum(n)::bigint as n_events from tiered group by 1 union all select 'discarded', 0")
def action_distribution(spark, sf):
    return ev.actions(src.evidence(spark, sf))


@query(f"with {E} select id, sum(case when d then 1 else 0 end) over (partition by session_id order by created_at, id)::int as visit from (select *, coalesce(created_at > lag(created_at) over (partition by session_id order by created_at, id) + interval 6 hour, false) as d from evidence)")
def heuristic_sessions(spark, sf):
    return ev.heuristic_sessions(src.evidence(spark, sf)).select("id", "visit")


@query(f"with {E} select session_id, id, row_number() over (partition by session_id order by created_at desc, id desc)::int as rank from evidence qualify rank <= 5")
def evidence_last5(spark, sf):
    return reports.last_evidence(src.evidence(spark, sf))


@query(f"with {E}, t as (select session_id, tool, count(*) as n from evidence group by all) select e.session_id, count(*) as n_events, count(distinct tool) as n_tools, count(distinct scope_ref) as n_scopes, min(created_at) as first_at, max(created_at) as last_at, (select arg_min(tool, (-n, tool)) from t where t.session_id = e.session_id) as top_tool from evidence e group by e.session_id")
def session_summary_stats(spark, sf):
    return reports.session_stats(src.evidence(spark, sf))


@query(f"with {E} select distinct session_id from evidence anti join (select o_custkey as session_id from orders where o_orderpriority = '1-URGENT') s using (session_id)")
def sessions_without_summary(spark, sf):
    """Sessions with evidence and no summary; urgent orders' customers stand for sessions that have one."""
    have = src.read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("session_id"))
    return src.evidence(spark, sf).select("session_id").distinct().join(have, "session_id", "left_anti")


@query(f"with {E} select count(*) as n_events, count(distinct session_id) as n_sessions, round(count(*) filter (status in ('retained','latent')) / count(*), 6) as retention_rate, round(count(*) filter (status = 'discarded') / count(*), 6) as discard_rate, min(created_at) as first_at, max(created_at) as last_at from evidence")
def rate_metrics(spark, sf):
    return reports.rates(src.evidence(spark, sf))


@query("with w as (select label as g, count(*) filter (vec_id % 3 = 0) as hits, count(*) as n from embeddings group by label), p as (select *, hits / n::double as p from w) select g as label, hits, n, round(greatest(0e0, (p + 38416e-4 / (2 * n)) / (1 + 38416e-4 / n) - 196e-2 * sqrt(p * (1 - p) / n + 38416e-4 / (4e0 * n * n)) / (1 + 38416e-4 / n)), 6) as low, round(least(1e0, (p + 38416e-4 / (2 * n)) / (1 + 38416e-4 / n) + 196e-2 * sqrt(p * (1 - p) / n + 38416e-4 / (4e0 * n * n)) / (1 + 38416e-4 / n)), 6) as high from p")
def wilson_interval(spark, sf):
    return reports.hit_interval(src.read(spark, sf, "embeddings"), "label", F.col("vec_id") % 3 == 0)


# ---- sessions ------------------------------------------------------------------------------------------------------


@query("select conv_id, turn, user_turn from (select conv_id, turn, role, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as user_turn from conversations) where role = 'assistant'")
def turn_pairs(spark, sf):
    return reports.turn_pairs(src.read(spark, sf, "conversations"))


@query("with a as (select conv_id, turn, turn - row_number() over (partition by conv_id order by turn) as g from conversations where role = 'assistant') select conv_id, min(turn) as start_turn, count(*) as n_turns from a group by conv_id, g")
def assistant_runs(spark, sf):
    return reports.assistant_runs(src.read(spark, sf, "conversations"))


@query("with b as (select *, ((row_number() over (partition by conv_id order by turn) - 1) // 5)::int as batch from conversations) select conv_id, batch, min(turn) as first_turn, max(turn) as last_turn, sum(length(text))::bigint as n_chars from b group by all")
def buffer_batches(spark, sf):
    return reports.buffer_batches(src.read(spark, sf, "conversations"))


@query(f"""with {M}, {E}, w as (select session_id, id, lag(created_at) over (partition by session_id order by created_at, id) as start_at, created_at as end_at from evidence)
select w.session_id, count(*) as n_memories from w join memories m on m.created_at > coalesce(w.start_at, timestamp '1900-01-01') and m.created_at <= w.end_at group by w.session_id""")
def session_windows(spark, sf):
    """Memories created within the windows between a session's consecutive events: a range join by day."""
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    day = lambda c: F.expr(f"cast({c} as date)")
    days = src.memories(spark, sf).groupBy(day("created_at").alias("day"), "created_at").agg(F.count("*").alias("n"))
    first = days.agg(F.coalesce(F.min("day"), F.lit("1970-01-01").cast("date")).alias("first"))  # one row
    wins = src.evidence(spark, sf).select("session_id", F.lag("created_at").over(w).alias("start_at"), F.col("created_at").alias("end_at")).crossJoin(F.broadcast(first))
    start = F.greatest(F.coalesce(day("start_at"), F.col("first")), F.col("first"))
    wins = wins.where(start <= day("end_at")).withColumn("day", F.explode(F.sequence(start, day("end_at"))))
    hit = wins.join(days, "day").where((F.col("start_at").isNull() | (F.col("created_at") > F.col("start_at"))) & (F.col("created_at") <= F.col("end_at")))
    return hit.groupBy("session_id").agg(F.sum("n").alias("n_memories"))


# ---- lifecycle -----------------------------------------------------------------------------------------------------


_LINES = lambda c: f"replace({c}, chr(13) || chr(10), chr(10))"
_TRIGGERS = f"list_sort(list_transform(triggers, lambda x: (list_position({list(lifecycle.TRIGGERS)}, x), x)))"
#: The identity of a memory and the hash of its content, as expressions of its columns.
IDENTITY_SQL = f"sha256(to_json(struct_pack(type := type, summary := {_LINES('summary')}, details := {_LINES('details')}, \"scopeGlob\" := {_LINES('scope_glob')}, \"lifecycleTriggers\" := list_transform({_TRIGGERS}, lambda x: x[2])))::varchar)"
CONTENT_SQL = f"sha256(to_json(struct_pack(summary := {_LINES('summary')}, details := {_LINES('details')}))::varchar)"


@query(f"""with {M}, h as (select id, created_at, {IDENTITY_SQL} as identity_key, sha256('memory:' || {CONTENT_SQL}) as c from memories)
select identity_key, arg_min(id, (created_at, id)) as id, count(*) as copies, c[1:8] || '-' || c[9:12] || '-5' || c[14:16] || '-' || ['8','9','a','b'][('0x' || c[17])::int % 4 + 1] || c[18:20] || '-' || c[21:32] as content_id from h group by identity_key, c""")
def exact_dedup_hash(spark, sf):
    return lifecycle.exact_dedup(src.memories(spark, sf))


_re = lambda n, p: p.encode().decode("unicode_escape") if n == "invisible_unicode_character" else p


def hits_sql(field: str, where: str, some=scan.BLOCK, prefix: str = "") -> str:
    """A list of the matches of block patterns in ``field``."""
    parts = (f"list_transform(regexp_extract_all({field}, '{_re(n, p)}'), lambda x: {{'name': '{prefix}{n}', 'category': '{c}', 'match': left('{where}' || x, 100)}})" for n, c, p in some)
    return f"flatten([{', '.join(parts)}])"


#: Base64 strings of both fields as texts: a rest of one character dropped, padding filled up. Other bytes than ASCII show as escapes here, which no pattern meets.
_BARE = "list_transform(list_concat(regexp_extract_all(summary, '[A-Za-z0-9+/]{40,}={0,2}'), regexp_extract_all(details, '[A-Za-z0-9+/]{40,}={0,2}')), lambda c: rtrim(c, '='))"
_FULL = f"list_transform({_BARE}, lambda b: case length(b) % 4 when 0 then b when 1 then left(b, length(b) - 1) else b || repeat('=', 4 - length(b) % 4) end)"


def scan_sql(rows: str) -> str:
    """The relation ``rows`` (summary, details and others) with the list column threats."""
    own = f"list_concat({hits_sql('summary', 'summary: ')}, {hits_sql('details', 'details: ')})"
    both = hits_sql("(summary || ' ' || details)", "cross-field: summary: ")
    names = lambda c: f"list_transform({c}, lambda y: y.name)"
    first = f"list_filter(cr, lambda x, i: not list_contains({names('own')}, x.name) and list_position({names('cr')}, x.name) = i)"
    hidden = f"flatten(list_transform(plain, lambda t: {hits_sql('t', 'base64-decoded: details: ', scan.KEYS, 'base64_encoded_')}))"
    plain = f"list_transform({_FULL}, lambda b: from_base64(b)::varchar)"
    return f"(select * exclude (own, cr, plain), list_concat(own, {first}, {hidden}) as threats from (select *, {own} as own, {both} as cr, {plain} as plain from {rows}))"


@query(f"""with {M}, n as (select 'm' || lpad(user_id::varchar, 12, '0') as id, count(*) as n from events group by 1), o as (
select *, case when created_at < timestamp '{AS_OF}' - interval 30 day then 'expired' when len(threats) > 0 then 'unsafe' when confidence < 85e-2 then 'low_confidence' when coalesce(n, 0) < 3 then 'little_evidence' when type = 'policy' then 'policy' when type not in ('pitfall','workflow') then 'type_not_allowed' else 'promoted' end as outcome from {scan_sql('memories')} left join n using (id) where status = 'candidate')
select id, outcome, case outcome when 'promoted' then 'active' when 'expired' then 'rejected' else 'candidate' end as status, case when outcome = 'promoted' then 'auto' else promotion_source end as promotion_source,
 case when outcome = 'promoted' then timestamp '{AS_OF}' + interval 14 day else ttl_expires_at end as ttl_expires_at, case when outcome = 'promoted' then 0 else validation_count end::int as validation_count from o""")
def promotion_gates(spark, sf):
    """Candidates and what an automatic promotion makes of them; events are linked to memories by user."""
    counts = src.read(spark, sf, "events").groupBy(F.concat(F.lit("m"), F.lpad(F.col("user_id").cast("string"), 12, "0")).alias("id")).agg(F.count("*").alias("n"))
    return lifecycle.promotion(src.memories(spark, sf), counts, AS_OF)


@query(f"with {M} select id, len(threats) as n_threats from {scan_sql('memories')} where len(threats) > 0")
def security_threats(spark, sf):
    """How many threats the scan finds in each memory that isn't safe."""
    return scan.threats(src.memories(spark, sf)).groupBy("id").agg(F.count("*").alias("n_threats"))


@query()
def security_warnings(spark, sf):
    """Warnings by text; the repetition rule needs a back reference, which the checking SQL engine lacks."""
    return src.memories(spark, sf).select("id", F.array_join(scan.warnings(F.col("details")), ",").alias("warnings"))


@query(f"""with recursive {M}, chain as (select id, id as anc, supersedes_id as nxt, 0 as depth, [id] as path from memories
 union all select c.id, r.id, r.supersedes_id, c.depth + 1, list_append(c.path, r.id) from chain c join memories r on r.id = c.nxt where not list_contains(c.path, r.id))
 select id, anc as ancestor_id, depth::int as depth, array_to_string(path, '>') as path from chain where depth > 0""")
def lineage_recursive(spark, sf):
    """The way from each memory to each of its ancestors."""
    return changes.paths(changes.ancestors(src.memories(spark, sf).select("id", "supersedes_id"), src.checkpointed))


@query(f"""with {M}, ev as (select 'm' || lpad(doc_id::varchar, 12, '0') as id, coalesce(max(quality), 0) = 1 as yes, coalesce(max(toxic), 0) = 1 as no from labels group by 1),
c as (select *, case when status = 'active' and no then 'demoted' when status = 'active' and yes and promotion_source = 'auto' then 'revalidated' else 'kept' end as change from memories join ev using (id) where yes or no)
select id, change, case change when 'demoted' then 'stale' else status end as status, (validation_count + case when change = 'revalidated' then 1 else 0 end)::int as validation_count, case when change = 'revalidated' then timestamp '{AS_OF}' + interval 14 day else ttl_expires_at end as ttl_expires_at from c""")
def revalidate(spark, sf):
    """Memories that labels speak for (quality) or against (toxic)."""
    labels = src.read(spark, sf, "labels").withColumn("id", F.concat(F.lit("m"), F.lpad(F.col("doc_id").cast("string"), 12, "0")))
    return lifecycle.revalidated(src.memories(spark, sf), labels.where("quality = 1").select("id"), labels.where("toxic = 1").select("id"), AS_OF)
