"""Samples that spread over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread_positions(n: Column, k: int) -> Column:
    """The k positions from 0 to n - 1, evenly spread and cut to whole numbers. The arithmetic is that of doubles in this order, which decides the cuts."""
    step = (n - 1).cast("double") / F.lit(float(max(k - 1, 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == k - 1, n - 1).otherwise(F.floor(i.cast("double") * step)).cast("long"))


def time_spread_sample(df: DataFrame, level: str, *order: Column | str, k: int = 50) -> DataFrame:
    """Of each level, rows at k spread positions in order; levels of k rows or fewer are kept whole.

    Positions need the level's rows in one order. Where a level may be very large, make `order` distinct and the
    columns few: the window sorts and spills, and only the kept rows go on.
    """
    w = Window.partitionBy(level)
    placed = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_at", (F.row_number().over(w.orderBy(*order)) - 1).cast("long"))
    # membership by arithmetic: a row is kept if it is the cut of a spread position near its own
    near = F.floor((F.col("_at").cast("double") * (k - 1)) / F.greatest(F.col("_n") - 1, F.lit(1)))
    step = (F.col("_n") - 1).cast("double") / F.lit(float(max(k - 1, 1)))

    def cut(i: Column) -> Column:
        return F.when(i >= k - 1, F.col("_n") - 1).otherwise(F.floor(i.cast("double") * step)).cast("long")

    hit = (cut(near) == F.col("_at")) | (cut(near + 1) == F.col("_at"))
    return placed.filter((F.col("_n") <= k) | hit).drop("_n", "_at")
