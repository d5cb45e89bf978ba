"""Queries of the activation modes: requests with and without texts against all memories."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import expanded_query, glob_regex
from ..operators import hybrid, index, modes, retrieval, selection
from ..sources import adapters as src
from .queries import AS_OF, BYTES, LEX, M, R, SCORE, query

TEXTS = 100  # request ids of benchmark items start here


def _requests(spark, sf: str) -> DataFrame:
    """The fixed requests, and one for each benchmark item whose id is divisible by 20, with its text and vector."""
    fixed = src.requests(spark).withColumn("vec_id", F.lit(None).cast("long"))
    even = (F.floor(F.col("item_id") / 20) % 2) == 0
    texts = src.read(spark, sf, "benchmark").where("item_id % 20 = 0").select(
        (F.col("item_id") + TEXTS).alias("request_id"), F.when(even, "before_model").otherwise("before_tool").alias("trigger"), F.when(even, ".").otherwise("src/src0/a.ts").alias("scope_ref"),
        F.when(~even, "bash").alias("tool"), F.col("text").alias("query"), F.col("item_id").alias("vec_id"),
    )
    return fixed.unionByName(texts)


def _rows(spark, sf: str) -> DataFrame:
    """Every request with every eligible memory, what each gate says and the scores. The requests are the caller's stated set."""
    m = selection.gates(src.memories(spark, sf), AS_OF).where("kind is null").withColumn("regex", glob_regex(F.col("scope_glob")))
    m = m.withColumn("base", scoring.memory_score(AS_OF)).withColumn("bytes", scoring.payload_bytes())
    m = m.select("id", "seq", "type", "triggers", "scope_glob", "activation_class", "importance", "confidence", "updated_at", "created_at", "relevant_tools", "regex", "base", "bytes")
    both = m.crossJoin(selection.bounded_broadcast(_requests(spark, sf)))  # every pair is a row of the suppression log
    listed = F.coalesce(F.array_contains("relevant_tools", F.col("tool")), F.lit(False))
    both = both.withColumn("trigger_ok", F.array_contains("triggers", F.col("trigger"))).withColumn("in_scope", F.regexp_like("scope_ref", F.col("regex")))
    both = both.withColumn("tool_ok", F.col("tool").isNull() | F.col("relevant_tools").isNull() | listed)
    both = both.withColumn("passes", F.expr("trigger_ok and in_scope and tool_ok")).withColumn("has_query", F.col("query") != "")
    boost = F.when((F.col("trigger") == "before_tool") & listed, modes.TOOL_BOOST).otherwise(0.0)
    return both.withColumn("boosted", F.col("base") + boost).drop("regex", "triggers", "relevant_tools")


def _lists(spark, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of all text requests: by the vector of a memory, by the vector of its summary, and by words."""
    r = _requests(spark, sf).where("query <> ''")
    e = src.read(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    q = r.join(e, "vec_id").select("request_id", "vec")
    m = selection.gates(src.memories(spark, sf), AS_OF).where("kind is null").select("id", "seq", "summary", "details")
    full = hybrid.dense_scores(q, m.join(e, F.col("seq") == F.col("vec_id")).select("id", "vec"))
    brief = hybrid.dense_scores(q, m.join(e, F.col("seq") + 7 == F.col("vec_id")).select("id", "vec"))
    words = index.shared(spark, sf, "eligible", lambda: m.select("id", "summary", "details"))
    return full, brief, index.search(words, r.select("request_id", "query"), save=src.checkpointed)


def _activation(found: DataFrame, rows: DataFrame) -> DataFrame:
    """``found`` (request_id, id, score, source, rank) with the activation score. A few rows a request: written once and sent to ``rows``, not those to them."""
    found = selection.bounded_broadcast(src.checkpointed(found))
    kinds = F.when(F.col("source") == "vector", scoring.normalize_retrieval(F.col("score"), "vector"))
    kinds = kinds.when(F.col("source") == "hybrid", scoring.normalize_retrieval(F.col("score"), "hybrid")).otherwise(scoring.normalize_retrieval(F.col("score"), "lexical"))
    return rows.select("request_id", "id", "base").join(found.withColumn("found", kinds), ["request_id", "id"]).select("request_id", "id", "source", "rank", scoring.activation_score(F.col("base"), F.col("found")).alias("score"))


def _staged(spark, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _rows(spark, sf)
    # The baseline layer is the same for all requests; what it leaves is the retrieval limit.
    layer = modes.fill(rows.where("activation_class = 'baseline'").select("request_id", "id", F.col("base").alias("score"), "bytes", F.lit(0).alias("stage"), modes.total_order(F.col("base")).alias("place")), ["place"])
    sizes = layer.groupBy("request_id").agg(F.count("*").alias("n"))
    limits = _requests(spark, sf).join(sizes, "request_id", "left").select("request_id", (selection.MAX_MEMORIES - F.coalesce("n", F.lit(0))).alias("most"))
    able = rows.where("has_query and activation_class <> 'baseline' and (scope_ref = '.' or in_scope)").select("request_id", "id", "in_scope")
    # A few rows a request, which several steps read: written once instead of searched again.
    found = src.checkpointed(_activation(hybrid.retrieve(able, limits, *_lists(spark, sf), selection.MAX_MEMORIES), rows))
    return rows, found, src.checkpointed(modes.staged(rows, found))


def _final(spark, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rows, found, chosen = _staged(spark, sf)
    wide = rows.select("request_id", "id", "type", "activation_class", "scope_glob", "has_query", "importance", "confidence", "updated_at", "created_at").join(selection.bounded_broadcast(chosen), ["request_id", "id"])
    latest = Window.partitionBy("request_id").orderBy(F.desc("updated_at"), F.desc("created_at"), "id")
    fresh = rows.where("passes and not has_query").select("request_id", "id", "bytes", F.row_number().over(latest).alias("nth")).where(F.col("nth") <= selection.MAX_MEMORIES + 1)
    return rows, found, chosen, modes.balanced(wide, fresh)


# SQL: the same steps. ``fold`` walks the rows of a request in order.
SCOPED = """case m.seq % 4 when 0 then true when 1 then starts_with(r.scope_ref, replace(m.scope_glob, '**', ''))
  when 2 then regexp_full_match(r.scope_ref, replace(replace(m.scope_glob, '.', '\\.'), '*', '[^/]*')) else starts_with(r.scope_ref, 'docs/') end"""
ROWS = f"""{M}, {R}, req as (select request_id, trigger, scope_ref, tool, query, null::bigint as vec_id from requests union all
 select item_id + {TEXTS}, case when (item_id // 20) % 2 = 0 then 'before_model' else 'before_tool' end, case when (item_id // 20) % 2 = 0 then '.' else 'src/src0/a.ts' end,
  case when (item_id // 20) % 2 <> 0 then 'bash' end, text, item_id from benchmark where item_id % 20 = 0),
elig as (select *, {BYTES} as bytes, {SCORE} as base from memories where status = 'active' and not coalesce(ttl_expires_at < timestamp '{AS_OF}', false)),
rows0 as (select r.request_id, r.query <> '' as has_query, r.scope_ref, r.trigger, m.id, m.type, m.scope_glob, m.activation_class, m.importance, m.confidence, m.updated_at, m.created_at, m.bytes, m.base,
  list_contains(m.triggers, r.trigger) as trigger_ok, {SCOPED} as in_scope, r.tool is null or m.relevant_tools is null or list_contains(m.relevant_tools, r.tool) as tool_ok,
  m.base + case when r.trigger = 'before_tool' and coalesce(list_contains(m.relevant_tools, r.tool), false) then 15e-2 else 0e0 end as boosted from elig m cross join req r),
rw as (select *, trigger_ok and in_scope and tool_ok as passes from rows0)"""
TOTAL = "round({s}, 12) desc, importance desc, confidence desc, updated_at desc, created_at desc, id"
DOT = "round(list_sum(list_transform(generate_series(1, len(v.embedding)), lambda i: v.embedding[i]::double * q.embedding[i]::double)), 9)"
SCORES = f"""qv as (select request_id, embedding from req join embeddings using (vec_id)),
fulls as (select q.request_id, m.id, {DOT} as score from qv q, elig m join embeddings v on v.vec_id = m.seq),
briefs as (select q.request_id, m.id, {DOT} as score from qv q, elig m join embeddings v on v.vec_id = m.seq + 7),
{LEX[: LEX.index("qtok as")].replace("from memories", "from elig")}
qt as (select distinct request_id, unnest(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(query, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[\\s\\pP]+'), lambda x: x <> '')) as q from req where query <> ''),
mean as (select f, greatest(avg(len(t)), 1e-9) as m, count(*) as docs from tok group by f), tf as (select id, f, len(t) as n, term, count(*) as tf from (select id, f, t, unnest(t) as term from tok) group by all),
df as (select f, term, count(*) as df from tf group by all),
lex as (select request_id, id, round(sum(ln(1e0 + (docs - df + 5e-1) / (df + 5e-1)) * tf * 22e-1 / (tf + 12e-1 * (25e-2 + n * 75e-2 / m)) * case f when 's' then 25e-1 else 1e0 end * case when q = term then 1e0 else 375e-3 end), 6) as score
  from qt join df on starts_with(term, q) join tf using (f, term) join mean using (f) group by all)"""


def retrieve_sql(able: str, tag: str = "") -> str:
    """CTEs up to ``hit`` (request_id, id, score, source, rank) for candidates ``able`` (request_id, id, in_scope, most) by ``base_id`` of the scores."""
    rank = lambda part, s="score": f"row_number() over (partition by request_id order by {s} desc, id) as rank {part}"
    own = lambda t: f"select a.request_id, a.id, a.in_scope, a.most, a.wider, s.score from able a join {t} s on s.request_id = a.base_id and s.id = a.id"
    return f"""able0 as ({able}), able as (select *, least(count(*) over (partition by request_id), 2 * most) as wider from able0),
da as (select *, {rank("from (" + own("fulls") + ") qualify rank <= wider")}), db as (select *, {rank("from (" + own("briefs") + ") qualify rank <= wider")}),
dd as (select request_id, id, in_scope, most, wider, max(score) as score from (select * from da union all select * from db) group by all),
lists as (select request_id, id, in_scope, most, score, 'vector' as source, {rank("from dd qualify rank <= wider")} union all select request_id, id, in_scope, most, score, 'lexical', {rank("from (" + own("lex") + ") qualify rank <= wider")}),
fus as (select request_id, id, in_scope, most, round(sum(1e0 / (rank + 60)), 12) as rrf, max(score) as raw, min(rank) as own_rank, count(*) as n, min(source) as one from lists group by all),
fus2 as (select *, kinds = 1 as alone from fus join (select request_id, count(distinct source) as kinds from lists group by request_id) using (request_id)),
cut as (select * from fus2 qualify row_number() over (partition by request_id order by case when alone then own_rank else 0 end, rrf desc, id) <= most),
hit0 as (select request_id, id, round(case when n = 2 then rrf else raw end + case when not alone and in_scope then 5e-2 else 0e0 end, 9) as score, case when n = 2 then 'hybrid' else one end as source from cut),
hit as (select *, row_number() over (partition by request_id order by score desc, id)::int as rank from hit0)"""


def fill_sql(rows: str, order: str, first: str = "1 = 1") -> str:
    """CTEs up to ``final`` (request_id, id, rank, score, bytes): greedy fill of ``rows`` (request_id, id, bytes, score, stage)."""
    ok = "(case when n.stage = 0 then len(f.ids) < 2 and f.used + n.bytes <= 2048 else len(f.ids) < 10 and f.used + n.bytes <= 8192 end and not list_contains(f.ids, n.id))"
    return f"""numbered as (select request_id, id, bytes, score, stage, row_number() over (partition by request_id order by stage, {order}) as rn from {rows}),
fold as (select request_id, 0::bigint as rn, 0::bigint as used, []::varchar[] as ids, []::double[] as scores from (select distinct request_id from numbered)
  union all select f.request_id, n.rn, case when {ok} then f.used + n.bytes else f.used end, case when {ok} then list_append(f.ids, n.id) else f.ids end, case when {ok} then list_append(f.scores, n.score) else f.scores end
  from fold f join numbered n on n.request_id = f.request_id and n.rn = f.rn + 1),
final as (select request_id, unnest(ids) as id, unnest(scores) as score, generate_subscripts(ids, 1)::int as rank from (select request_id, max_by(ids, rn) as ids, max_by(scores, rn) as scores from fold group by request_id))"""


ACT = "case source when 'vector' then greatest(0e0, least(1e0, h.score)) when 'hybrid' then least(1e0, h.score * 61) else case when h.score <= 0 then 0e0 else h.score / (h.score + 1) end end"


def _baseline_cte() -> str:
    """The baseline layer by its own walk: CTE ``nb`` (request_id, n)."""
    order = TOTAL.format(s="base")
    return f"""bnum as (select id, bytes, row_number() over (order by {order}) as rn from (select distinct id, bytes, base, importance, confidence, updated_at, created_at from rw where activation_class = 'baseline')),
bfold as (select 0::bigint as rn, 0::bigint as used, 0::bigint as n union all select b.rn, case when f.n < 2 and f.used + b.bytes <= 2048 then f.used + b.bytes else f.used end, case when f.n < 2 and f.used + b.bytes <= 2048 then f.n + 1 else f.n end from bfold f join bnum b on b.rn = f.rn + 1),
nb as (select max_by(n, rn) as n from bfold)"""


HYBRID = f"{ROWS}, {SCORES}, {_baseline_cte()}, " + retrieve_sql("select request_id, request_id as base_id, id, in_scope, 10 - nb.n as most from rw, nb where has_query and activation_class <> 'baseline' and (scope_ref = '.' or in_scope)")
STAGED = f"""{HYBRID}, st as (select request_id, id, bytes, base as score, 0 as stage, 0 as pos, importance, confidence, updated_at, created_at, base from rw where activation_class = 'baseline'
 union all select request_id, id, bytes, w.base * 4e-1 + ({ACT}) * 6e-1, 1, h.rank, importance, confidence, updated_at, created_at, w.base from rw w join hit h using (request_id, id)
 union all select request_id, id, bytes, boosted, 2, 0, importance, confidence, updated_at, created_at, base from rw where passes), {fill_sql("st", "pos, " + TOTAL.format(s="base"))}"""
BALANCED = f"""{STAGED}, ch as (select request_id, id, f.score as score0, f.rank, w.type, w.activation_class = 'baseline' as baseline, w.has_query, w.scope_glob, w.importance, w.confidence, w.updated_at, w.created_at, w.bytes from final f join rw w using (request_id, id)),
pen0 as (select *, split_part(scope_glob, '/', 1) as prefix, row_number() over (partition by request_id, split_part(scope_glob, '/', 1) order by {TOTAL.format(s="score0")}) as k from ch),
pen1 as (select *, case when prefix <> '' and k > 1 then score0 * 7e-1 else score0 end as score from pen0),
pen as (select *, row_number() over (partition by request_id order by {TOTAL.format(s="score")}) as rn from pen1),
walk as (select request_id, 0::bigint as rn, 0::bigint as used, []::varchar[] as ids, []::varchar[] as types, []::varchar[] as quota, []::varchar[] as budget from (select distinct request_id from pen)
 union all select f.request_id, n.rn, case when {{ok}} then f.used + n.bytes else f.used end, case when {{ok}} then list_append(f.ids, n.id) else f.ids end, case when {{ok}} then list_append(f.types, n.type) else f.types end,
  case when {{room}} and {{over}} then list_append(f.quota, n.id) else f.quota end, case when {{room}} and not {{over}} and f.used + n.bytes > 8192 then list_append(f.budget, n.id) else f.budget end
 from walk f join pen n on n.request_id = f.request_id and n.rn = f.rn + 1),
core as (select request_id, max_by(used, rn) as used, max_by(ids, rn) as ids, max_by(quota, rn) as quota, max_by(budget, rn) as budget, any_value(hq) as has_query from walk join (select request_id, bool_or(has_query) as hq from pen group by 1) using (request_id) group by request_id),
fresh as (select request_id, id, bytes, row_number() over (partition by request_id order by updated_at desc, created_at desc, id) as nth from rw where passes and not has_query),
pick0 as (select c.request_id, f.id, f.bytes, c.used, row_number() over (partition by c.request_id order by nth) as k from core c join fresh f on f.request_id = c.request_id and not list_contains(c.ids, f.id) where not c.has_query and len(c.ids) < 10),
pick as (select request_id, id from pick0 where k = 1 and used + bytes <= 8192),
back as (select c.request_id, arg_min(p.id, p.rn) as id from core c join pen p on p.request_id = c.request_id and not list_contains(c.ids, p.id) and c.used + p.bytes <= 8192 where len(c.ids) < 10 and not exists (select 1 from pick k where k.request_id = c.request_id) group by 1),
done as (select request_id, unnest(ids) as id, generate_subscripts(ids, 1)::int as rank, 'core' as how from core union all select request_id, pick.id, len(ids)::int + 1, 'exploration' from pick join core using (request_id)
 union all select request_id, back.id, len(ids)::int + 1, 'backfill' from back join core using (request_id)),
spare as (select request_id, unnest(quota) as id, 'quota' as how from core union all select request_id, unnest(budget), 'budget' from core)"""
BALANCED = BALANCED.format(
    ok="(len(f.ids) < case when n.has_query then 10 else 9 end and (n.baseline or len(list_filter(f.types, lambda x: x = n.type)) < case n.type when 'policy' then 3 when 'workflow' then 3 when 'pitfall' then 2 else 1 end) and f.used + n.bytes <= 8192)",
    room="len(f.ids) < case when n.has_query then 10 else 9 end",
    over="(not n.baseline and len(list_filter(f.types, lambda x: x = n.type)) >= case n.type when 'policy' then 3 when 'workflow' then 3 when 'pitfall' then 2 else 1 end)",
)


@query(f"with recursive {HYBRID} select request_id, id, round(score, 6) as score, source, rank from hit")
def hybrid_retrieval(spark, sf):
    """Dense by two indexes, lexical with prefixes, fused by rank; raw scores for hits of one list, boosts in scope."""
    rows = _rows(spark, sf)
    layer = modes.fill(rows.where("activation_class = 'baseline'").select("request_id", "id", F.col("base").alias("score"), "bytes", F.lit(0).alias("stage"), modes.total_order(F.col("base")).alias("place")), ["place"])
    limits = _requests(spark, sf).join(layer.groupBy("request_id").agg(F.count("*").alias("n")), "request_id", "left").select("request_id", (selection.MAX_MEMORIES - F.coalesce("n", F.lit(0))).alias("most"))
    able = rows.where("has_query and activation_class <> 'baseline' and (scope_ref = '.' or in_scope)").select("request_id", "id", "in_scope")
    return hybrid.retrieve(able, limits, *_lists(spark, sf), selection.MAX_MEMORIES).select("request_id", "id", F.round("score", 6).alias("score"), "source", "rank")


@query(f"with recursive {STAGED} select request_id, id, rank, round(score, 6) as score from final")
def activate_staged(spark, sf):
    """Baseline layer, retrieved rows, gated rows: the first fill of default mode."""
    return _staged(spark, sf)[2].select("request_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"with recursive {BALANCED} select request_id, id, rank, how from done")
def activate_default_full(spark, sf):
    """Default mode whole: staged fill, prefix penalty, type quotas with exempt baseline, exploration, backfill."""
    return _final(spark, sf)[3].where("rank > 0").select("request_id", "id", "rank", "how")


@query(f"""with recursive {BALANCED}, log as (select request_id, id, case when status <> 'active' then 'status_inactive' when ttl_expires_at < timestamp '{AS_OF}' then 'ttl_expired' end as kind from memories, req
 union all select request_id, h.id, 'budget_limit' from hit h anti join final f on f.request_id = h.request_id and f.id = h.id
 union all select request_id, w.id, case when not trigger_ok then 'trigger_mismatch' when not in_scope then 'scope_mismatch' when not tool_ok then 'tool_mismatch' else 'budget_limit' end from rw w anti join final f on f.request_id = w.request_id and f.id = w.id
 union all select request_id, id, case how when 'quota' then 'type_balance_limit' else 'budget_limit' end from spare)
select request_id, id, kind, count(*) as n from log where kind is not null group by all""")
def suppression_log(spark, sf):
    """Why memories were left out, by request; a bag, so a memory may appear for several kinds or more than once."""
    rows, found, chosen, last = _final(spark, sf)
    gated = selection.gates(src.memories(spark, sf), AS_OF).where("kind is not null").select("id", "kind").crossJoin(selection.bounded_broadcast(_requests(spark, sf).select("request_id")))
    key = ["request_id", "id"]
    missed = found.select(*key).join(chosen.select(*key), key, "left_anti").withColumn("kind", F.lit("budget_limit"))
    kind = F.when(~F.col("trigger_ok"), "trigger_mismatch").when(~F.col("in_scope"), "scope_mismatch").when(~F.col("tool_ok"), "tool_mismatch").otherwise("budget_limit")
    scoped = rows.select(*key, kind.alias("kind")).join(selection.bounded_broadcast(chosen.select(*key)), key, "left_anti")
    spare = last.where("rank = 0").select(*key, F.when(F.col("how") == "quota", "type_balance_limit").otherwise("budget_limit").alias("kind"))
    return gated.select(*key, "kind").unionByName(missed).unionByName(scoped).unionByName(spare).groupBy(*key, "kind").agg(F.count("*").alias("n"))


@query(f"with recursive {BALANCED} select request_id, type, scope_glob, array_to_string(triggers, ',') as triggers, count(*) as n, arg_min(id, (created_at, id)) as root_id from done join (select id, type, scope_glob, triggers, created_at from elig) using (id) group by all having count(*) > 1")
def activated_conflicts(spark, sf):
    """Groups of activated memories with the same type, scope and triggers."""
    m = src.memories(spark, sf).select("id", "type", "scope_glob", F.array_join("triggers", ",").alias("triggers"), "created_at")
    g = _final(spark, sf)[3].where("rank > 0").join(m, "id").groupBy("request_id", "type", "scope_glob", "triggers")
    return g.agg(F.count("*").alias("n"), F.min_by("id", F.struct("created_at", "id")).alias("root_id")).where("n > 1")


# ---- modes by session ----------------------------------------------------------------------------------------------

SUMS = """sums as (select conv_id as session_id, timestamp '2023-12-24' + to_hours((conv_id * 11 % 900)::int) as created_at, timestamp '2023-12-24' + to_hours((conv_id * 11 % 900)::int) + to_days((conv_id % 5)::int) as updated_at from (select distinct conv_id from conversations)),
win as (select *, lag(created_at) over (order by created_at, session_id) as start_at from sums)"""


def summaries(spark, sf) -> DataFrame:
    """One session summary for each conversation; times are functions of its id, its vector is the one of that number."""
    at = F.expr("timestamp_ntz '2023-12-24 00:00:00' + make_dt_interval(0, cast(conv_id * 11 % 900 as int))")
    return src.read(spark, sf, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("session_id"), at.alias("created_at"), (at + F.expr("make_dt_interval(cast(conv_id % 5 as int))")).alias("updated_at"))


def _matched(spark, sf, most: int, least: int = 0) -> DataFrame:
    """(request_id, session_id, ended_at, place): the ``most`` summaries nearest to each text request, filled up to ``least`` by last update."""
    s = summaries(spark, sf)
    e = src.read(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    r = _requests(spark, sf).where("query <> ''")
    near = hybrid.dense_scores(r.join(e, "vec_id").select("request_id", "vec"), s.join(e, F.col("session_id") == F.col("vec_id")).select(F.col("session_id").alias("id"), "vec"))
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), "id")
    near = near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("request_id", F.col("id").alias("session_id"), "place")
    if least:
        latest = s.orderBy(F.desc("updated_at"), "session_id").limit(most + least).select("session_id", F.col("updated_at").alias("at"))
        more = r.select("request_id").crossJoin(F.broadcast(latest)).join(near, ["request_id", "session_id"], "left_anti")
        have = near.groupBy("request_id").agg(F.count("*").alias("have"))
        nth = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("at"), "session_id"))
        more = more.withColumn("nth", nth).join(have, "request_id", "left").withColumn("have", F.coalesce("have", F.lit(0))).where(F.col("nth") + F.col("have") <= least)
        near = near.unionByName(more.select("request_id", "session_id", (F.col("have") + F.col("nth")).cast("int").alias("place")))
    return near.join(s.select("session_id", F.col("created_at").alias("ended_at")), "session_id")


def _by_session(spark, sf, chosen: DataFrame, per: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the requests' windows, and the best ones of each window, as many as ``per`` (asked, most) says: (request_id, session_id, place, id, score, rank)."""
    rows = modes.in_windows(_rows(spark, sf).where("has_query"), modes.with_start(chosen, summaries(spark, sf), src.checkpointed), src.checkpointed)
    part = src.checkpointed(rows.withColumn("asked", F.col("request_id")).withColumn("request_id", F.col("request_id") * 1_000_000 + F.col("place")))
    able = part.select("request_id", "asked", "id", "in_scope")
    keys = able.select("request_id", "asked").distinct()
    spread = lambda x: x.withColumnRenamed("request_id", "asked").join(keys, "asked").select("request_id", "id", "score")
    found = hybrid.retrieve(able.drop("asked"), keys.join(per, "asked").select("request_id", "most"), *map(spread, _lists(spark, sf)), selection.MAX_MEMORIES)
    return part, src.checkpointed(_activation(found, part))


MATCHED = "near as (select q.request_id, s.session_id, round(list_sum(list_transform(generate_series(1, len(v.embedding)), lambda i: v.embedding[i]::double * q.embedding[i]::double)), 9) as score from qv q, win s join embeddings v on v.vec_id = s.session_id), mt0 as (select *, row_number() over (partition by request_id order by score desc, session_id) as place from near qualify place <= {most})"
ENSURE = """, have as (select r.request_id, count(m.session_id) as have from req r left join mt0 m using (request_id) where r.query <> '' group by 1),
more as (select h.request_id, s.session_id, have + row_number() over (partition by h.request_id order by s.updated_at desc, s.session_id) as place from have h, win s where not exists (select 1 from mt0 m where m.request_id = h.request_id and m.session_id = s.session_id) qualify place <= 3)"""
WINDOWED = "mt as ({mt}), part as (select w.request_id * 1000000 + t.place as request_id, w.request_id as asked, t.place, w.* exclude (request_id) from rw w join mt t using (request_id) join win s using (session_id) where w.has_query and (s.start_at is null or w.created_at > s.start_at) and w.created_at <= s.created_at)"
PARTS = f"{ROWS}, {SUMS}, {SCORES}, "
TEMPORAL = PARTS + MATCHED.format(most=5) + ", " + WINDOWED.format(mt="select request_id, session_id, place from mt0") + ", " + retrieve_sql("select request_id, asked as base_id, id, in_scope, 3 as most from part") + f""",
none0 as (select p.*, row_number() over (partition by p.request_id order by created_at, id) as k from part p where not exists (select 1 from hit h where h.request_id = p.request_id)),
comb as (select asked as request_id, p.id, p.bytes, p.created_at, p.updated_at, p.base * 4e-1 + ({ACT}) * 6e-1 as score from part p join hit h using (request_id, id) union all select asked, id, bytes, created_at, updated_at, base from none0 where k <= 3),
st as (select request_id, id, bytes, score, 1 as stage, epoch_us(created_at) as pos from comb union all select request_id, id, bytes, base, 1, -epoch_us(updated_at) from rw where has_query and request_id not in (select request_id from comb)), """ + fill_sql("st", "pos, id")


@query(f"with recursive {TEMPORAL} select request_id, id, rank, round(score, 6) as score from final")
def activate_temporal(spark, sf):
    """The five nearest sessions, the best rows of each, in order of time; without any, the last updated memories."""
    part, found = _by_session(spark, sf, _matched(spark, sf, 5), _requests(spark, sf).select(F.col("request_id").alias("asked"), F.lit(3).alias("most")))
    best = part.select("request_id", "asked", "id", "bytes", "created_at", "base").join(selection.bounded_broadcast(found.select("request_id", "id", "score")), ["request_id", "id"])
    first = Window.partitionBy("request_id").orderBy("created_at", "id")
    rest = part.join(selection.bounded_broadcast(found.select("request_id").distinct()), "request_id", "left_anti").withColumn("k", F.row_number().over(first)).where("k <= 3")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    comb = best.select(F.col("asked").alias("request_id"), "id", "bytes", "score", micros("created_at").alias("at")).unionByName(rest.select(F.col("asked").alias("request_id"), "id", "bytes", F.col("base").alias("score"), micros("created_at").alias("at")))
    other = _rows(spark, sf).where("has_query").join(comb.select("request_id").distinct(), "request_id", "left_anti")
    comb = comb.unionByName(other.select("request_id", "id", "bytes", F.col("base").alias("score"), (-micros("updated_at")).alias("at")))
    return modes.fill(comb.withColumn("stage", F.lit(1)).withColumn("place", F.struct("at", "id")), ["place"]).select("request_id", "id", "rank", F.round("score", 6).alias("score"))


CROSS = PARTS + MATCHED.format(most=8) + ENSURE + ", " + WINDOWED.format(mt="select request_id, session_id, place from mt0 union all select request_id, session_id, place from more") + ", " + "counts as (select request_id, count(*) as n from mt group by 1), " + retrieve_sql("select p.request_id, asked as base_id, id, in_scope, greatest(1, ceil(10 / c.n)::int) as most from part p join counts c on c.request_id = p.asked") + f""",
none0 as (select p.*, greatest(1, ceil(10 / c.n)::int) as most, row_number() over (partition by p.request_id order by {TOTAL.format(s="base")}) as k from part p join counts c on c.request_id = p.asked where not exists (select 1 from hit h where h.request_id = p.request_id)),
st as (select asked as request_id, p.id, p.bytes, p.base * 4e-1 + ({ACT}) * 6e-1 as score, 1 as stage, h.rank as pos, p.place from part p join hit h using (request_id, id) union all select asked, id, bytes, base, 1, k, place from none0 where k <= most), """ + fill_sql("st", "pos, place, id")


@query(f"with recursive {CROSS} select request_id, id, rank, round(score, 6) as score from final")
def activate_cross_session(spark, sf):
    """The eight nearest sessions (three at least), their best rows in turn."""
    chosen = _matched(spark, sf, 8, 3)
    # With eight sessions each gives ceil(10 / 8) rows; fewer sessions give more, so limits go by request.
    n = chosen.groupBy(F.col("request_id").alias("asked")).agg(F.greatest(F.lit(1), F.ceil(F.lit(selection.MAX_MEMORIES) / F.count("*"))).cast("int").alias("most"))
    part, found = _by_session(spark, sf, chosen, n)
    best = part.select("request_id", "asked", "place", "id", "bytes", "base").join(selection.bounded_broadcast(found.select("request_id", "id", "score", F.col("rank").alias("at"))), ["request_id", "id"])
    first = Window.partitionBy("request_id").orderBy(modes.total_order(F.col("base")))
    rest = part.join(selection.bounded_broadcast(found.select("request_id").distinct()), "request_id", "left_anti").withColumn("at", F.row_number().over(first)).join(n, "asked").where("at <= most")
    cols = lambda x, s: x.select(F.col("asked").alias("request_id"), "id", "bytes", F.col(s).alias("score"), F.lit(1).alias("stage"), F.struct("at", F.col("place").alias("session"), "id").alias("place"))
    out = cols(best, "score").unionByName(cols(rest, "base"))
    return modes.fill(out, ["place"]).select("request_id", "id", "rank", F.round("score", 6).alias("score"))


STARTUP = f"""{ROWS}, {SUMS}, late as (select * from win order by updated_at desc, session_id limit 3),
rec as (select w.*, exists (select 1 from late l where (l.start_at is null or w.created_at > l.start_at) and w.created_at <= l.created_at) as recent from rw w),
st as (select request_id, id, bytes, base as score, 0 as stage, 0 as pos, base as near, base, importance, confidence, updated_at, created_at from rec where activation_class = 'baseline'
 union all select request_id, id, bytes, base + case when recent then 15e-2 else 0e0 end, 1, case when activation_class = 'startup' then 0 else 1 end, base + case when recent then 15e-2 else 0e0 end, base, importance, confidence, updated_at, created_at from rec where activation_class <> 'baseline' and (scope_ref = '.' or in_scope)),
{fill_sql("st", "pos, round(near, 12) desc, " + TOTAL.format(s="base"))}"""


@query(f"with recursive {STARTUP} select request_id, id, rank, round(score, 6) as score from final")
def activate_startup(spark, sf):
    """Baseline layer, then the startup class, then by score with a boost for memories of the last three sessions."""
    s = summaries(spark, sf)
    late = s.orderBy(F.desc("updated_at"), "session_id").limit(3).select(F.lit(0).alias("request_id"), "session_id", F.col("created_at").alias("ended_at"))
    m = src.memories(spark, sf).select(F.lit(0).alias("request_id"), "id", "created_at")
    recent = modes.in_windows(m, modes.with_start(late, s, src.checkpointed), src.checkpointed).select("id").distinct().withColumn("recent", F.lit(modes.RECENT_BOOST))
    rows = _rows(spark, sf).join(recent, "id", "left").withColumn("near", F.col("base") + F.coalesce("recent", F.lit(0.0)))
    order = lambda at, score: F.struct(at.alias("at"), (-F.round(score, 12)).alias("near"), modes.total_order(F.col("base")).alias("key")).alias("place")
    base = rows.where("activation_class = 'baseline'").select("request_id", "id", "bytes", F.col("base").alias("score"), F.lit(0).alias("stage"), order(F.lit(0), F.col("base")))
    later = F.when(F.col("activation_class") == "startup", 0).otherwise(1)
    rest = rows.where("activation_class <> 'baseline' and (scope_ref = '.' or in_scope)").select("request_id", "id", "bytes", F.col("near").alias("score"), F.lit(1).alias("stage"), order(later, F.col("near")))
    return modes.fill(base.unionByName(rest), ["place"]).select("request_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"with {ROWS} select request_id, scope_ref = '.' as broad from req")
def broad_scope(spark, sf):
    """Requests of the whole project."""
    return _requests(spark, sf).select("request_id", (F.col("scope_ref") == ".").alias("broad"))


@query(f"with {ROWS} select request_id, case when scope_ref = '.' then query else regexp_replace(translate(scope_ref, '/', ' '), '\\.[^.]+$', '') || ': ' || query end as expanded from req where query <> ''")
def query_expansion(spark, sf):
    """The texts from which the requests' vectors would be made."""
    return _requests(spark, sf).where("query <> ''").select("request_id", expanded_query(F.col("scope_ref"), F.col("query")).alias("expanded"))
