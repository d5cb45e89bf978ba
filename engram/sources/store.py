"""Tables with versions: files by bucket of a key, and one manifest a version that names them.

A change stages new files for the buckets that it touches and then commits a manifest that points to them and, for all other buckets,
to the files of the version before. Manifests are renamed into place without overwriting, so a version appears whole or not at all; a
writer that fails leaves files that no manifest names. Several tables change together in one commit. A writer that finds its
version taken commits on top of it if no bucket that it touched was changed meanwhile, and fails otherwise.

Rows stay with Spark throughout; the driver sees bucket numbers and folder names only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Conflict(RuntimeError):
    """Another writer has changed the same buckets."""


class Staged(NamedTuple):
    """Files of one table that no version names yet: bucket -> folder, None for a bucket without rows; ``whole`` replaces all buckets."""

    table: str
    key: tuple[str, ...]
    buckets: int
    schema: str
    folders: dict[int, str | None]
    whole: bool


def bucket_of(key: Iterable[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


@contextmanager
def swept(spark: SparkSession):
    """Within it, the shuffle files of a query go once its rows are written."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Store:
    """A folder of versioned tables, in any file system that Spark writes to and that renames atomically."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- files and manifests

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def head(self) -> int:
        """The newest version, 0 if there is none."""
        return max((int(n[:-5]) for n in self._names(f"{self.path}/versions") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """table -> its key, buckets, schema and folders at ``version`` (the newest if None)."""
        version = self.head() if version is None else version
        if not version:
            return {}
        fs, p = self._fs(f"{self.path}/versions/{version:09}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> bool:
        """Whether ``manifest`` became ``version``; False if that version is taken."""
        fs, new = self._fs(f"{self.path}/versions/{uuid.uuid4().hex}.tmp")
        out = fs.create(new, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/{version:09}.json")
        none = jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(new, place, options)
            return True
        except Exception as e:
            fs.delete(new, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    # ---- reading

    def read(self, table: str, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of ``table`` at ``version``, or of some of its buckets."""
        return self._rows(self.manifest(version)[table], buckets)

    def _rows(self, entry: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(entry["schema"]))
        folders = [f for b, f in entry["folders"].items() if buckets is None or int(b) in set(buckets)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def staged_rows(self, staged: Staged) -> DataFrame:
        """The rows of staged files, before they are committed."""
        return self._rows({"schema": staged.schema, "folders": {b: f for b, f in staged.folders.items() if f}})

    def touched(self, rows: DataFrame, key: Iterable[str], buckets: int) -> list[int]:
        """The buckets that ``rows`` fall in, at most ``buckets`` numbers."""
        return [r.b for r in rows.select(bucket_of(key, buckets).alias("b")).distinct().collect()]

    # ---- writing

    def stage(self, table: str, rows: DataFrame, key: tuple[str, ...], buckets: int, touched: Iterable[int] | None = None, placed: bool = False, rounds: int = 1) -> Staged:
        """Write ``rows`` as the new content of the buckets ``touched`` (all, if None), sorted by ``key`` within each file.

        ``placed``: the rows have their ``_bucket`` already and few tasks have rows of one bucket, so they aren't dealt anew.
        ``rounds``: deal and write the rows of so many groups of buckets one after the other. Rows are read again for each, but only those of one group are in shuffle files at a time.
        """
        folder = f"{self.path}/data/{table}-{uuid.uuid4().hex}"
        at = rows if placed else rows.withColumn("_bucket", bucket_of(key, buckets))
        with swept(self.spark):
            for i in range(rounds):
                some = at if rounds == 1 else at.where(F.col("_bucket") % rounds == i)
                # Adaptive execution splits a bucket that is too large for a task, so one hot key doesn't end in one file.
                dealt = some if placed else some.hint("rebalance", F.col("_bucket"))
                dealt.sortWithinPartitions("_bucket", *key).write.mode("append").option("compression", "zstd").partitionBy("_bucket").parquet(folder)
        written = {int(n[8:]): f"{folder}/{n}" for n in self._names(folder) if n.startswith("_bucket=")}
        some = written if touched is None else {b: written.get(b) for b in touched}
        if set(written) - set(some):
            raise ValueError("rows outside the touched buckets")
        # Whether a column may be null depends on how rows were made, so all may, at every depth.
        schema = rows.drop("_bucket").schema.json()
        for name in ("nullable", "containsNull", "valueContainsNull"):
            schema = schema.replace(f'"{name}":false', f'"{name}":true')
        return Staged(table, tuple(key), buckets, schema, some, touched is None)

    def commit(self, base: int, staged: Iterable[Staged], retries: int = 20) -> int:
        """Publish staged files that were made from version ``base``; returns the new version. Raises ``Conflict``."""
        staged = list(staged)
        before = self.manifest(base)
        for _ in range(retries):
            head = self.head()
            now = self.manifest(head) if head != base else before
            for s in staged:
                old, new = (m.get(s.table, {"folders": {}})["folders"] for m in (before, now))
                changed = {b for b in {*old, *new} if old.get(b) != new.get(b)}
                if (changed if s.whole else changed & set(map(str, s.folders))):
                    raise Conflict(f"{s.table} was changed by version {head}")
            out = dict(now)
            for s in staged:
                known = now.get(s.table)
                if known and not s.whole and (tuple(known["key"]), known["buckets"], known["schema"]) != (s.key, s.buckets, s.schema):
                    raise ValueError(f"{s.table} has another key, number of buckets or schema")
                folders = {} if s.whole or not known else dict(known["folders"])
                folders |= {str(b): f for b, f in s.folders.items()}
                out[s.table] = {"key": list(s.key), "buckets": s.buckets, "schema": s.schema, "folders": {b: f for b, f in folders.items() if f}}
            if self._publish(head + 1, out):
                return head + 1
        raise Conflict("too many writers")

    # ---- changes of one table

    def create(self, table: str, rows: DataFrame, key: tuple[str, ...], buckets: int = 16) -> int:
        """The first version of ``table``."""
        base = self.head()
        if table in self.manifest(base):
            raise Conflict(f"{table} exists")
        return self.commit(base, [self.stage(table, rows, key, buckets)])

    def change(self, table: str, rows: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], base: int | None = None) -> int:
        """The version in which the buckets of ``rows`` hold ``how(old rows of these buckets, rows)``. ``base``: the version that the writer has read."""
        base = self.head() if base is None else base
        entry = self.manifest(base)[table]
        key = tuple(entry["key"])
        some = self.touched(rows, key, entry["buckets"])
        if not some:
            return base
        old = self._rows(entry, some)
        new = how(old, rows).select(*old.columns)
        return self.commit(base, [self.stage(table, new, key, entry["buckets"], some)])

    def insert(self, table: str, rows: DataFrame, base: int | None = None) -> int:
        """Rows with new keys are added; rows whose key exists are ignored, and of several new rows of a key the first by all columns stays."""
        key = self.manifest(base)[table]["key"]

        def add(old: DataFrame, new: DataFrame) -> DataFrame:
            one = new.select(*old.columns).groupBy(*key).agg(F.min(F.struct(*(c for c in old.columns if c not in key))).alias("_v")).select(*key, "_v.*")
            return old.unionByName(one.join(old.select(*key), list(key), "left_anti"))

        return self.change(table, rows, add, base)

    def update(self, table: str, rows: DataFrame, base: int | None = None) -> int:
        """Columns of ``rows`` (one row a key) that aren't null replace those of existing rows; unknown keys are ignored."""
        key = self.manifest(base)[table]["key"]

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            more = [c for c in new.columns if c not in key]
            named = new.select(*key, *(F.col(c).alias(f"_new {c}") for c in more))
            joined = old.join(named, list(key), "left")
            return joined.select(*(F.coalesce(F.col(f"`_new {c}`"), F.col(c)).alias(c) if c in more else F.col(c) for c in old.columns))

        return self.change(table, rows, merge, base)

    def upsert(self, table: str, rows: DataFrame, keep: tuple[str, ...] = (), fill: tuple[str, ...] = (), base: int | None = None) -> int:
        """``rows`` (one row a key) replace or join the table's. Of a replaced row, columns ``keep`` stay, and those of ``fill`` where the new value is null."""
        key = self.manifest(base)[table]["key"]

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            was = old.select(*key, F.lit(True).alias("_was"), *(F.col(c).alias(f"_old {c}") for c in (*keep, *fill)))
            both = new.join(was, list(key), "left")
            value = lambda c: F.when(F.col("_was"), F.col(f"`_old {c}`")).otherwise(F.col(c)) if c in keep else F.coalesce(F.col(c), F.col(f"`_old {c}`")) if c in fill else F.col(c)
            return both.select(*(value(c).alias(c) for c in old.columns)).unionByName(old.join(new.select(*key), list(key), "left_anti"))

        return self.change(table, rows, merge, base)

    def delete(self, table: str, keys: DataFrame, base: int | None = None) -> int:
        """The rows with one of ``keys`` go."""
        key = self.manifest(base)[table]["key"]
        return self.change(table, keys, lambda old, gone: old.join(gone.select(*key), list(key), "left_anti"), base)
