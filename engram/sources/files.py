"""File sources and sinks beside Parquet: rule files, score cards, session logs, SQL dumps and skill pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug


def rule_bullets(spark: SparkSession, path: str, least: int = 5) -> DataFrame:
    """Bullets (``- `` or ``* ``) of text files with at least ``least`` characters, as baseline policy memories."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where(F.col("line").rlike(r"^[-*] "))
    rules = lines.select(F.trim(F.expr("substring(line, 3)")).alias("summary")).where(F.length("summary") >= least)
    return rules.select("summary", F.lit("policy").alias("type"), F.lit("baseline").alias("activation_class"), F.lit(0.8).alias("confidence"), F.lit(0.8).alias("importance"))


def scorecard(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


def scenario_headings(spark: SparkSession, path: str) -> DataFrame:
    """(number, title) of lines ``## Scenario N: title``."""
    p = r"^## Scenario (\d+): (.*)$"
    rows = spark.read.text(path).where(F.col("value").rlike(p))
    return rows.select(F.regexp_extract("value", p, 1).cast("int").alias("number"), F.regexp_extract("value", p, 2).alias("title"))


def session_turns(spark: SparkSession, path: str, least: int = 10) -> DataFrame:
    """Turns of JSON lines (role, parts[type, text]): text parts joined; those of at most ``least`` characters go."""
    rows = spark.read.schema("role string, parts array<struct<type:string,text:string>>").json(path)
    text = F.array_join(F.transform(F.filter("parts", lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    return rows.select("role", text.alias("text")).where(F.length("text") > least)


def sql_literal(df: DataFrame, name: str) -> F.Column:
    kind = dict(df.dtypes)[name]
    c = F.col(name)
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        out = c.cast("string")
    elif kind == "boolean":
        out = c.cast("int").cast("string")
    elif kind == "binary":
        out = F.concat(F.lit("X'"), F.lower(F.hex(c)), F.lit("'"))
    else:
        out = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(out, F.lit("NULL"))


def sql_dump(df: DataFrame, table: str) -> DataFrame:
    """One INSERT statement for each row; write it with ``.write.text``."""
    values = F.concat_ws(", ", *(sql_literal(df, c) for c in df.columns))
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("), values, F.lit(");")).alias("value"))


def skill_pages(memories: DataFrame, min_confidence: float = 0.0, min_importance: float = 0.0) -> DataFrame:
    """(slug, value): a page for each active memory above the thresholds; write with ``partitionBy("slug").text``."""
    rows = memories.where("status = 'active'").where((F.col("confidence") >= min_confidence) & (F.col("importance") >= min_importance))
    page = F.concat(F.lit("# "), F.col("summary"), F.lit("\n\n"), F.col("details"), F.lit("\n\nScope: "), F.col("scope_glob"))
    return rows.select(slug(F.col("summary")).alias("slug"), page.alias("value"))
