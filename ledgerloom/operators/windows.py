"""Row choice and run logic as window plans: latest, best, first seen, runs, as-of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list, order: list, k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of each key in the given order; end the order with a unique key for a fixed result."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rank or "_rn", F.row_number().over(w)).where(F.col(rank or "_rn") <= k)
    return out if rank else out.drop("_rn")


def islands(df: DataFrame, keys: list, order: list, value: Column) -> DataFrame:
    """Consecutive rows of one value as runs: numbered by how many changes stand before them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(value), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn("run", F.sum("_change").over(w)).drop("_change")


def as_of(left: DataFrame, right: DataFrame, key: str, order: str, value: str, reach: int) -> DataFrame:
    """For each left row, the value of the nearest right row strictly before it, less than `reach` away.

    Both sides are interleaved and the last value carried on, so there is one
    exchange and no range join; among right rows at one place the first wins.
    """
    marks = right.groupBy(key, order).agg(F.min(value).alias(value))
    both = left.withColumn("_mark", F.lit(None).cast("string")).withColumn("_at", F.lit(None).cast(left.schema[order].dataType)).unionByName(
        marks.select(key, order, F.col(value).alias("_mark"), F.col(order).alias("_at")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    carried = both.withColumn("_m", F.last("_mark", True).over(w)).withColumn("_w", F.last("_at", True).over(w))
    return carried.where(F.col("_at").isNull()).withColumn(value, F.when(F.col(order) - F.col("_w") < reach, F.col("_m"))).drop("_mark", "_at", "_m", "_w")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows with new ones in their place: the new row of a key wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return first_by(both, key, [F.desc("_new")]).drop("_new")
