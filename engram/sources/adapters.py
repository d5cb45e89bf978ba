"""Logical tables (memories, evidence, turns, vectors, requests) as views of the driver's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store

AS_OF = "2024-02-01 00:00:00"
TYPES = ("policy", "workflow", "pitfall", "architecture_constraint", "decision")
STATUSES = ("active", "active", "active", "active", "active", "candidate", "superseded", "stale")
PHRASES = (
    "build failed with timeout", "tests passed and issue fixed", "decided to switch to parquet", "always run the linter",
    "module boundary for the adapter layer", "looked at the file", "do not commit the secret", "previously used to retry", "   ", "note",
)
#: request id, trigger, scope, tool, query text
REQUESTS = (
    (0, "before_model", "src/src0/a.ts", None, ""),
    (1, "before_tool", "src/src1/b.ts", "bash", ""),
    (2, "before_model", "src/src2/deep/c.ts", None, ""),
    (3, "session_start", "docs/readme.md", None, ""),
    (4, "before_tool", "docs/guide/x.md", "edit", ""),
    (5, "before_model", ".", None, ""),
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share. Only a local session without that setting gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("engram.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="engram-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("engram.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, for loops.

    A checkpoint keeps the constraints of the plan that made it, so over many rounds the driver holds and compares ever more of them; it also keeps
    the partitions of every part of a union. Files have neither.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(spark: SparkSession, name: str) -> Store:
    """A new, empty store in the shared folder."""
    return Store(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


def _pick(values: tuple[str, ...], index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories; every attribute is a function of the id, the source and the text."""
    d = F.col("doc_id")
    src = F.coalesce("source", F.lit("none"))
    created = F.expr("timestamp_ntz '2024-01-31 00:00:00' - make_dt_interval(cast(doc_id % 40 as int))")
    updated = F.expr("timestamp_ntz '2024-01-31 00:00:00' - make_dt_interval(cast(doc_id % 40 as int)) + make_dt_interval(0, cast(doc_id % 5 as int))")
    text = F.coalesce("text", F.lit(""))
    trig = F.when(d % 3 == 0, F.array(F.lit("before_model"))).when(d % 3 == 1, F.array(F.lit("before_tool"), F.lit("before_model"))).otherwise(F.array(F.lit("session_start")))
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("m"), F.lpad(d.cast("string"), 12, "0")).alias("id"),
        d.alias("seq"),
        _pick(TYPES, d).alias("type"),
        F.substring(F.element_at(F.split(text, "\n"), 1), 1, 120).alias("summary"),
        text.alias("details"),
        F.when(d % 4 == 0, F.lit("**/*")).when(d % 4 == 1, F.concat(F.lit("src/"), src, F.lit("/**"))).when(d % 4 == 2, F.concat(F.lit("src/"), src, F.lit("/*.ts"))).otherwise(F.lit("docs/**")).alias("scope_glob"),
        trig.alias("triggers"),
        F.when(d % 10 == 0, "baseline").when(d % 10 == 1, "startup").otherwise("scoped").alias("activation_class"),
        (F.lit(0.5) + (d % 50) / F.lit(100.0)).alias("confidence"),
        (F.lit(0.4) + (d % 60) / F.lit(100.0)).alias("importance"),
        _pick(STATUSES, d).alias("status"),
        F.when(d % 3 == 0, "auto").otherwise("manual").alias("promotion_source"),
        (d % 4).cast("int").alias("validation_count"),
        created.alias("created_at"),
        updated.alias("updated_at"),
        F.when(d % 2 == 1, updated + F.expr("interval 1 day")).alias("last_verified_at"),
        F.when(d % 7 == 0, created + F.expr("interval 14 days")).alias("ttl_expires_at"),
        F.when(d % 6 == 0, F.array(F.lit("bash"))).alias("relevant_tools"),
        F.when((d >= 8) & (d % 16 >= 8), F.concat(F.lit("m"), F.lpad((d - 8).cast("string"), 12, "0"))).alias("supersedes_id"),
        F.col("lang"),
    )


MEMORIES_SQL = """memories as (select 'm' || lpad(doc_id::varchar, 12, '0') as id, doc_id as seq,
  ['policy','workflow','pitfall','architecture_constraint','decision'][doc_id % 5 + 1] as type,
  substr(string_split(coalesce(text,''), chr(10))[1], 1, 120) as summary, coalesce(text,'') as details,
  case doc_id % 4 when 0 then '**/*' when 1 then 'src/' || coalesce(source,'none') || '/**' when 2 then 'src/' || coalesce(source,'none') || '/*.ts' else 'docs/**' end as scope_glob,
  case doc_id % 3 when 0 then ['before_model'] when 1 then ['before_tool','before_model'] else ['session_start'] end as triggers,
  case when doc_id % 10 = 0 then 'baseline' when doc_id % 10 = 1 then 'startup' else 'scoped' end as activation_class,
  5e-1 + (doc_id % 50) / 1e2 as confidence, 4e-1 + (doc_id % 60) / 1e2 as importance,
  ['active','active','active','active','active','candidate','superseded','stale'][doc_id % 8 + 1] as status,
  case when doc_id % 3 = 0 then 'auto' else 'manual' end as promotion_source, (doc_id % 4)::int as validation_count,
  timestamp '2024-01-31' - to_days((doc_id % 40)::int) as created_at,
  timestamp '2024-01-31' - to_days((doc_id % 40)::int) + to_hours(doc_id % 5) as updated_at,
  case when doc_id % 2 = 1 then timestamp '2024-01-31' - to_days((doc_id % 40)::int) + to_hours(doc_id % 5) + interval 1 day end as last_verified_at,
  case when doc_id % 7 = 0 then timestamp '2024-01-31' - to_days((doc_id % 40)::int) + interval 14 day end as ttl_expires_at,
  case when doc_id % 6 = 0 then ['bash'] end as relevant_tools,
  case when doc_id >= 8 and doc_id % 16 >= 8 then 'm' || lpad((doc_id - 8)::varchar, 12, '0') end as supersedes_id, lang from documents)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evidence."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        e.alias("id"),
        F.col("user_id").alias("session_id"),
        F.col("event_type").alias("tool"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("src/"), F.coalesce(k, F.lit(0)) % 4).alias("scope_ref"),
        F.col("event_type").alias("title"),
        _pick(PHRASES, e).alias("excerpt"),
        F.when(e % 3 == 0, F.concat(F.lit('{"path": "'), F.coalesce(k, F.lit(0)), F.lit('"}'))).otherwise(F.lit("{}")).alias("args_json"),
        F.when(e % 11 == 0, "retained").when(e % 13 == 0, "latent").when(e % 17 == 0, "discarded").otherwise("pending").alias("status"),
    )


EVIDENCE_SQL = f"""evidence as (select event_id as id, user_id as session_id, event_type as tool, ts as created_at,
  'src/' || (coalesce(json_extract_string(props, '$.k')::bigint, 0) % 4)::varchar as scope_ref, event_type as title, {list(PHRASES)!r}[event_id % 10 + 1] as excerpt,
  case when event_id % 3 = 0 then '{{"path": "' || coalesce(json_extract_string(props, '$.k')::bigint, 0)::varchar || '"}}' else '{{}}' end as args_json,
  case when event_id % 11 = 0 then 'retained' when event_id % 13 = 0 then 'latent' when event_id % 17 = 0 then 'discarded' else 'pending' end as status from events)"""


def requests(spark: SparkSession) -> DataFrame:
    """The fixed activation requests; a literal table, so it may be broadcast."""
    return spark.createDataFrame(list(REQUESTS), "request_id long, trigger string, scope_ref string, tool string, query string")


REQUESTS_SQL = "requests(request_id, trigger, scope_ref, tool, query) as (values " + ", ".join(
    f"({r[0]}::bigint, '{r[1]}', '{r[2]}', {repr(r[3]) if r[3] else 'null'}, '{r[4]}')" for r in REQUESTS
) + ")"
