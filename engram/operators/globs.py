"""Globs against paths by equality: a glob meets only paths that begin with its literal folders.

The folders of a glob before its first wildcard are its key; a path is listed under each of its leading folders. Distinct globs and
distinct paths are joined on that key, and only what meets is held against the whole expression. Rows come back by equality on their glob.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_regex, normal_path


def literal_folders(glob: Column) -> Column:
    """The folders before the first wildcard, or the whole of a glob without one."""
    plain = normal_path(glob)
    head = F.regexp_extract(plain, r"^[^*?{\[]*", 0)
    return F.when(F.length(head) == F.length(plain), plain).otherwise(F.regexp_replace(F.regexp_extract(head, r"^(.*/)?", 0), "/$", ""))


def leading_folders(path: Column) -> Column:
    """Every leading part of a path at a slash, the empty one and the whole path among them."""
    parts = F.split(path, "/")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))


def matches(globs: DataFrame, paths: DataFrame) -> DataFrame:
    """(glob, path) of the distinct ``globs`` (glob) and ``paths`` (path) that match; nulls match nothing."""
    g = globs.where("glob is not null").select("glob").distinct().select("glob", literal_folders(F.col("glob")).alias("folders"), glob_regex(F.col("glob")).alias("regex"))
    p = paths.where("path is not null").select("path").distinct().select("path", normal_path(F.col("path")).alias("whole"))
    p = p.select("path", "whole", F.explode(leading_folders(F.col("whole"))).alias("folders"))
    return g.join(p, "folders").where(F.regexp_like("whole", F.col("regex"))).select("glob", "path")


def in_scope(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """``rows`` (scope_glob, triggers, ...) with each of ``requests`` (trigger, scope_ref, ...) whose trigger they have and whose path their glob matches."""
    met = matches(rows.select(F.col("scope_glob").alias("glob")), requests.select(F.col("scope_ref").alias("path")))
    asked = requests.join(met.select(F.col("path").alias("scope_ref"), F.col("glob").alias("scope_glob")), "scope_ref")
    return rows.withColumn("trigger", F.explode(F.array_distinct("triggers"))).join(asked, ["scope_glob", "trigger"])
