"""Rows in a total order, without sorting a key's rows in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Save = Callable[[DataFrame], DataFrame]


def previous(rows: DataFrame, order: list[str], columns: list[str], save: Save) -> DataFrame:
    """``rows`` with ``prev``: the struct of ``columns`` of the row before in ``order`` (ascending, nulls first), null for the first.

    Rows are dealt by ranges of the whole order, so the rows of a hot key are in several tasks; the last row of each range goes to the
    next one. Rows of equal order come in any order. The driver sees a row a range.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = save(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    one = F.struct(*columns)
    key = F.struct(*order)
    ends = {r._part: r.last for r in placed.groupBy("_part").agg(F.max_by(one, key).alias("last")).collect()}
    before, at = [], None
    for p in sorted(ends):
        before.append((p, at))
        at = ends[p]
    kind = placed.select(one.alias("prev")).schema["prev"].dataType.simpleString()
    table = spark.createDataFrame(before, f"_part int, _before {kind}")
    own = Window.partitionBy("_part").orderBy(*order)
    within = placed.withColumn("_nth", F.row_number().over(own)).withColumn("prev", F.lag(one).over(own))
    return within.join(F.broadcast(table), "_part").withColumn("prev", F.when(F.col("_nth") == 1, F.col("_before")).otherwise(F.col("prev"))).drop("_part", "_nth", "_before")
