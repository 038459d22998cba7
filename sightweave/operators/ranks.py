"""Exact ranks and percentiles of any number of values, by range-partitioned counts.

Equal values are counted together; the distinct values are laid out in ranges by value, each range
is numbered in its own task, and the ranges' totals (one row each) are summed up before them. So
neither a group nor all values have to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightweave.session import cut


def counted(df: DataFrame, keys: list[str], value: str, counts: dict[str, Column]) -> DataFrame:
    """keys, value, the counts, and below_<count>: how much of it lies at smaller values of the same key.

    counts are aggregates by name. Rows with a null value are left out; null keys form a key of their own.
    """
    values = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[c.alias(n) for n, c in counts.items()])
    laid = cut(values.repartitionByRange(*keys, value)).withColumn("_part", F.spark_partition_id())  # written, so that a range keeps its number
    totals = laid.groupBy(*keys, "_part").agg(*[F.sum(n).alias(f"_{n}") for n in counts])
    by = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", *keys, *[F.coalesce(F.sum(f"_{n}").over(by), F.lit(0)).alias(f"_{n}") for n in counts])
    on = F.col("l._part") == F.col("b._part")
    for k in keys:
        on &= F.col(f"l.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = laid.alias("l").join(F.broadcast(before.alias("b")) if not keys else before.alias("b"), on).select("l.*", *[F.col(f"b._{n}") for n in counts])
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(*keys, value, *counts, *[(F.col(f"_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"below_{n}") for n in counts])


def linear_percentiles(df: DataFrame, keys: list[str], value: str, ps: list[float]) -> DataFrame:
    """keys, n, values: the percentiles ps of each key, linear between neighbouring values, as an array in their order.

    Rows with a null value are left out; a key without values gives no row, and no keys one row of all.
    """
    ranked = counted(df, keys, value, {"n": F.count(F.lit(1))})
    total = ranked.groupBy(*keys).agg(F.sum("n").alias("total"))
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}"))
    both = ranked.alias("r").join(F.broadcast(total.alias("t")) if not keys else total.alias("t"), on).select("r.*", "t.total")
    # The value of rank i (from 0) is the one with below <= i < below + n.
    at = lambda i: F.max(F.when((F.col("below_n") <= i) & (i < F.col("below_n") + F.col("n")), F.col(value)))
    spots = [F.lit(p) * (F.col("total") - 1) for p in ps]
    picked = both.groupBy(*keys).agg(F.first("total").alias("n"), *[at(F.floor(s)).alias(f"lo{i}") for i, s in enumerate(spots)], *[at(F.ceil(s)).alias(f"hi{i}") for i, s in enumerate(spots)])
    steps = [F.lit(p) * (F.col("n") - 1) for p in ps]
    values = [F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (s - F.floor(s)) for i, s in enumerate(steps)]
    return picked.select(*keys, "n", F.array(*values).alias("values"))
