"""Lifecycle: hashes, dedup, promotion gates and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import with_safety

#: The order of triggers.
TRIGGERS = ("session_start", "before_model", "before_tool", "after_tool")

def _line_ends(c: str) -> Column:
    return F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\r\n"), F.lit("\n"))


def content_hash() -> Column:
    """SHA-256 of the JSON of summary and details, line ends as newlines. JSON marks where a field ends, so no text can look like two."""
    return F.sha2(F.to_json(F.struct(_line_ends("summary").alias("summary"), _line_ends("details").alias("details"))), 256)


def identity_key() -> Column:
    """SHA-256 of the JSON of what makes a memory the same: type, summary, details, scope and its triggers in their fixed order."""
    place = lambda x: F.array_position(F.array(*map(F.lit, TRIGGERS)), x)
    triggers = F.transform(F.array_sort(F.transform("triggers", lambda x: F.struct(place(x).alias("k"), x.alias("v")))), lambda x: x["v"])
    same = F.struct(F.col("type").alias("type"), _line_ends("summary").alias("summary"), _line_ends("details").alias("details"), _line_ends("scope_glob").alias("scopeGlob"), triggers.alias("lifecycleTriggers"))
    return F.sha2(F.to_json(same), 256)


def memory_id(hash_: Column) -> Column:
    """The id that follows from a content hash: a UUID of version 5 from SHA-256."""
    hex_ = F.sha2(F.concat(F.lit("memory:"), hash_), 256)
    part = lambda a, n: F.substring(hex_, a, n)
    variant = F.substring(F.lit("89ab"), (F.conv(part(17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def exact_dedup(rows: DataFrame) -> DataFrame:
    """One row for each identity: the earliest memory (created_at, id), how many there were, and the id its content would get."""
    hashed = rows.select("id", "created_at", identity_key().alias("identity_key"), content_hash().alias("content_hash"))
    one = hashed.groupBy("identity_key").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"), F.count("*").alias("copies"), F.min("content_hash").alias("content_hash"))
    return one.select("identity_key", "id", "copies", memory_id(F.col("content_hash")).alias("content_id"))


#: Days that an automatic promotion is valid.
VALID_DAYS = 14


def promotion(candidates: DataFrame, evidence_counts: DataFrame, as_of: str, min_confidence: float = 0.85, min_evidence: int = 3, expiry_days: int = 30, allowed: tuple[str, ...] = ("pitfall", "workflow")) -> DataFrame:
    """(id, outcome, status, promotion_source, ttl_expires_at, validation_count): the first gate that fails, or promoted, and what the candidate is then.

    A promoted one is active for ``VALID_DAYS``; an expired one is rejected; others stay candidates. ``evidence_counts``: id, n.
    """
    rows = with_safety(candidates.where("status = 'candidate'")).join(evidence_counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    old = F.col("created_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {expiry_days} days")
    outcome = (
        F.when(old, "expired").when(~F.col("safe"), "unsafe").when(F.col("confidence") < min_confidence, "low_confidence")
        .when(F.col("n") < min_evidence, "little_evidence").when(F.col("type") == "policy", "policy").when(~F.col("type").isin(*allowed), "type_not_allowed").otherwise("promoted")
    )
    won = F.col("outcome") == "promoted"
    until = F.lit(as_of).cast("timestamp_ntz") + F.expr(f"interval {VALID_DAYS} days")
    return rows.withColumn("outcome", outcome).select(
        "id", "outcome", F.when(won, "active").when(F.col("outcome") == "expired", "rejected").otherwise("candidate").alias("status"), F.when(won, "auto").otherwise(F.col("promotion_source")).alias("promotion_source"),
        F.when(won, until).otherwise(F.col("ttl_expires_at")).alias("ttl_expires_at"), F.when(won, 0).otherwise(F.col("validation_count")).alias("validation_count"),
    )


def revalidated(memories: DataFrame, reinforced: DataFrame, contradicted: DataFrame, as_of: str) -> DataFrame:
    """(id, change, status, validation_count, ttl_expires_at) of the memories that evidence speaks for or against (id each).

    A reinforced active memory that was promoted automatically counts one more validation and is valid for ``VALID_DAYS`` again; a contradicted active
    memory becomes stale, which comes first; nothing else changes.
    """
    yes, no = reinforced.select("id").distinct().withColumn("_for", F.lit(True)), contradicted.select("id").distinct().withColumn("_against", F.lit(True))
    rows = memories.join(yes, "id", "left").join(no, "id", "left").where("_for or _against")
    active = F.col("status") == "active"
    change = F.when(active & F.col("_against"), "demoted").when(active & F.col("_for") & (F.col("promotion_source") == "auto"), "revalidated").otherwise("kept")
    until = F.lit(as_of).cast("timestamp_ntz") + F.expr(f"interval {VALID_DAYS} days")
    rows = rows.withColumn("change", change)
    is_ = lambda x: F.col("change") == x
    return rows.select("id", "change", F.when(is_("demoted"), "stale").otherwise(F.col("status")).alias("status"), (F.col("validation_count") + is_("revalidated").cast("int")).alias("validation_count"), F.when(is_("revalidated"), until).otherwise(F.col("ttl_expires_at")).alias("ttl_expires_at"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The next version of a table: for each key the row with the latest ``order``; new rows win ties. Keeps ``created_at``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key)
    kept = both.withColumn("_n", F.row_number().over(w.orderBy(F.desc(order), F.desc("_new"))))
    if "created_at" in old.columns:
        kept = kept.withColumn("created_at", F.min("created_at").over(w))
    return kept.where("_n = 1").drop("_n", "_new")
