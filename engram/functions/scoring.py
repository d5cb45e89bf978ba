"""Closed-form scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_days(since: Column, as_of: str) -> Column:
    seconds = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(since.cast("timestamp"))
    return F.greatest(F.lit(0.0), seconds / F.lit(86400e6))


def memory_score(as_of: str) -> Column:
    """importance x confidence x freshness x trust."""
    fresh = F.greatest(F.lit(0.75), F.lit(1.0) - age_days(F.coalesce("last_verified_at", "updated_at", "created_at"), as_of) * 0.01)
    v = F.col("validation_count")
    trust = F.when(F.col("promotion_source") == "manual", 1.0).when(v == 0, 0.65).when(v == 1, 0.8).otherwise(0.95)
    return F.col("importance") * F.col("confidence") * fresh * trust


def payload_bytes() -> Column:
    """UTF-8 length of the JSON that a memory sends."""
    fields = F.struct("id", "type", "summary", "details", F.col("scope_glob").alias("scopeGlob"), F.col("triggers").alias("lifecycleTriggers"), "status")
    return F.octet_length(F.to_json(fields))


def normalize_retrieval(score: Column, kind: str) -> Column:
    """A retrieval score of kind vector, hybrid or lexical on [0, 1]."""
    if kind == "vector":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    if kind == "hybrid":
        return F.least(F.lit(1.0), score * 61)
    return F.when(score <= 0, 0.0).otherwise(score / (score + 1))


def activation_score(memory: Column, retrieval: Column) -> Column:
    return memory * 0.4 + retrieval * 0.6


def tier(events: Column, tags: Column) -> Column:
    both = F.array_contains(tags, "failure_signal") & F.array_contains(tags, "has_file_context")
    return F.when(events >= 3, 1).when(both, 1).when(events >= 2, 2).when(F.size(tags) > 0, 2).otherwise(3)


def confidence_by_tier(tier: Column, events: Column) -> Column:
    return F.when(tier == 1, F.least(F.lit(0.95), events * 0.02 + 0.8)).when(tier == 2, F.least(F.lit(0.85), events * 0.05 + 0.6)).otherwise(0.4)


def importance_by_tags(tags: Column, events: Column) -> Column:
    has = lambda t, v: F.when(F.array_contains(tags, t), v).otherwise(0.0)
    total = F.lit(0.4) + has("failure_signal", 0.15) + has("decision_signal", 0.1) + has("architecture_signal", 0.1) + has("convention_signal", 0.05)
    return F.least(F.lit(0.95), total + F.least(F.lit(0.2), (events - 1) * 0.1))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; (0, 0) without trials."""
    p = hits / n
    mid = (p + z * z / (n * 2)) / (F.lit(1.0) + z * z / n)
    half = F.sqrt(p * (F.lit(1.0) - p) / n + z * z / (n * n * 4)) * z / (F.lit(1.0) + z * z / n)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), mid + half))
