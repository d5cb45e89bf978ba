"""Bootstrap interval of a mean, with one stream of random numbers that all tasks share by jumping ahead in it.

The stream is a linear congruential generator in whole numbers; a step is an affine map modulo 2^31, so k steps are the maps of the bits of k
(k = 1, 2, 4, ...) one after another. Resample i takes the draws from i n on, wherever it runs, and adds them in their order: the
result is that of a plain loop to the last bit, in any number of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the generator.
TIMES, PLUS, MASK, SEED = 1103515245, 12345, 0x7FFFFFFF, 42
#: Values a group may have: each task holds them all.
MOST_VALUES = 1 << 20


def _jumps(bits: int = 62) -> list[tuple[int, int]]:
    """The affine maps of 1, 2, 4, ... steps."""
    out, a, c = [], TIMES, PLUS
    for _ in range(bits):
        out.append((a, c))
        a, c = a * a & MASK, (a * c + c) & MASK
    return out


def jumped(steps: Column) -> Column:
    """The state of the generator after ``steps`` (long) steps from the seed."""
    maps = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(c).cast("long").alias("c")) for a, c in _jumps()))
    state = F.struct(F.lit(SEED).cast("long").alias("s"), steps.cast("long").alias("k"))
    move = lambda x, m: F.when(x["k"] % 2 == 1, (m["a"] * x["s"] + m["c"]).bitwiseAND(F.lit(MASK))).otherwise(x["s"])
    return F.aggregate(maps, state, lambda x, m: F.struct(move(x, m).alias("s"), F.shiftright(x["k"], 1).alias("k")), lambda x: x["s"])


def bootstrap_mean(rows: DataFrame, group: str, order: str, x: str, iterations: int = 2000) -> DataFrame:
    """(group, n, lower, point, upper): the mean of ``x`` and the 2.5 % and 97.5 % places of ``iterations`` resampled means.

    Values are drawn from the group in ``order`` (unique). Null values don't count. A group of more than ``MOST_VALUES`` values is an error.
    """
    held = rows.where(F.col(x).isNotNull()).select(group, order, F.col(x).cast("double").alias("x"))
    most = held.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    if most > MOST_VALUES:
        raise ValueError(f"a group has {most} values, more than {MOST_VALUES}")
    lists = held.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "x"))), lambda v: v["x"]).alias("xs"))
    n = F.size("xs")
    total = lambda a, v: a + v
    lists = lists.withColumn("point", F.aggregate("xs", F.lit(0.0), total) / n)
    # The resamples are dealt over tasks, and each meets all groups.
    each = rows.sparkSession.range(iterations).join(F.broadcast(lists))  # bounded by MOST_VALUES a group
    step = lambda s: (s * TIMES + PLUS).bitwiseAND(F.lit(MASK))
    zero = F.struct(jumped(F.col("id") * n).alias("s"), F.lit(0.0).alias("sum"))

    def draw(a: Column, _: Column) -> Column:
        s = step(a["s"])
        return F.struct(s.alias("s"), (a["sum"] + F.get(F.col("xs"), F.least(F.floor(s / F.lit(float(MASK)) * n).cast("int"), n - 1))).alias("sum"))

    means = each.select(group, "point", n.alias("n"), (F.aggregate("xs", zero, draw, lambda a: a["sum"]) / n).alias("mean"))
    sorted_ = means.groupBy(group, "point", "n").agg(F.array_sort(F.collect_list("mean")).alias("means"))  # ``iterations`` numbers
    at = lambda share: F.get("means", F.lit(int(share * iterations)))
    return sorted_.select(group, F.col("n").cast("long").alias("n"), at(0.025).alias("lower"), "point", at(0.975).alias("upper"))
