"""Small helpers that all training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separator between words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a temporary folder; on a cluster its absence is an error, as executors
    would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("engram.scratch.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="engram-")
        spark.conf.set("engram.scratch.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor re-reads files instead of repeating the work, and later exchanges start
    from a plain scan, so adaptive execution can split their skewed partitions.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # this query's shuffle files go once its rows are written
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more, so a long job's disk doesn't grow with its steps."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        base = scratch(df.sparkSession).split(":", 1)[-1].lstrip("/")
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.split(":", 1)[-1].lstrip("/").startswith(f"{base}/"):
                path = sc._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int = 20_000) -> DataFrame:
    """``df``, marked for a broadcast only if it has at most ``most`` rows; larger ones are joined by shuffle.

    The count is cheap on a table of ``materialize``.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def text_of(col: str | Column = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``docs`` has not."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def masked(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with all columns but ``used`` under names that no operator uses; ``toDF(*docs.columns)`` undoes it."""
    return docs.toDF(*(c if c in used else f"other {i}" for i, c in enumerate(docs.columns)))


def columns_of(names: list[str]) -> list[Column]:
    """Columns by their exact names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a non-null text."""
    return F.array_remove(F.split(text, SPACE), "")
