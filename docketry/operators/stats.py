"""Counts, shares, length statistics, quantiles and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, *columns: str, nulls: bool = True) -> DataFrame:
    """n of each combination of values, with or without nulls."""
    if not nulls:
        df = df.dropna(subset=list(columns))
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def item_counts(df: DataFrame, items: Column) -> DataFrame:
    """n of each item of a list column."""
    return df.select(F.explode(items).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def length_stats(df: DataFrame, value: Column, *keys: str, digits: int | None = None) -> DataFrame:
    """n, mean, median and standard deviation (of the sample) of a number by key; rounded half to even if digits are given."""
    rounded = (lambda c: F.bround(c, digits)) if digits is not None else (lambda c: c)
    x = df.withColumn("_x", value)
    return x.groupBy(*keys).agg(F.count("_x").alias("n"), rounded(F.avg("_x")).alias("mean"), rounded(F.median("_x")).alias("median"), rounded(F.stddev_samp("_x")).alias("std"))


def conditional_pct(df: DataFrame, condition: Column, *keys: str, digits: int = 2) -> DataFrame:
    """rows, rows where the condition holds, and their share in per cent."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(condition).alias("n_true"))
    return out.withColumn("pct", F.round(100.0 * F.col("n_true") / F.col("n"), digits))


def segment_stats(df: DataFrame, segments: list[str], least: int = 15) -> DataFrame:
    """For each text column: n of rows longer than `least`, their share in per cent, mean and median length of these; 0 where there are none. One pass."""
    long = df.select(*[F.length(F.coalesce(F.col(s), F.lit(""))).alias(s) for s in segments]).unpivot([], segments, "segment", "chars")
    x = F.when(F.col("chars") > least, F.col("chars"))
    return long.groupBy("segment").agg(F.count(x).alias("n"), F.round(100.0 * F.count(x) / F.count(F.lit(1)), 1).alias("pct"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.median(x), F.lit(0.0)).alias("median"))


def slot_stats(df: DataFrame, items: Column, least: int = 15) -> DataFrame:
    """segment_stats of every place of a list of texts (slot, from 0), as far as the longest list goes; the share is of all rows. Equal lengths of a place are counted first, so only distinct lengths are ordered."""
    length = F.when(F.length("item") > least, F.length("item"))
    counts = df.select(F.posexplode(items).alias("slot", "item")).select("slot", length.alias("chars")).groupBy("slot", "chars").agg(F.count("chars").alias("k"))
    each = Window.partitionBy("slot")
    ranked = counts.withColumns({"n": F.sum("k").over(each), "upto": F.sum("k").over(each.orderBy("chars"))})
    lower, upper = (F.min(F.when(F.col("upto") > F.floor((F.col("n") - i) / 2), F.col("chars"))) for i in (1, 0))
    slots = ranked.groupBy("slot").agg(F.max("n").alias("n"), (F.sum(F.col("chars") * F.col("k")) / F.nullif(F.max("n"), F.lit(0))).alias("mean"), ((lower + upper) / 2).alias("median"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    share = F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct")
    return slots.crossJoin(F.broadcast(total)).select("slot", "n", share, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "median")])


def shares(counts: DataFrame, within: list[str], n: str = "n") -> DataFrame:
    """counts with each row's share of its group's sum."""
    return counts.withColumn("share", F.col(n) / F.sum(n).over(Window.partitionBy(*within)))


def group_range(df: DataFrame, value: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def lower_rank_quantiles(df: DataFrame, value: str, probabilities: tuple[float, ...] = (0.25, 0.5, 0.75), bins: int = 4096) -> DataFrame:
    """least, q25 and so on, greatest; a quantile is the value of rank floor((n - 1) * p), from 0.

    Equal bins are counted first; running sums over the bins (at most bins + 1 rows) tell in which bin each rank lies, and
    only the distinct values of these bins are put in order.
    """
    x = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    edges = x.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("total"))
    lo, hi = F.col("lo").cast("double"), F.col("hi").cast("double")
    bin_ = F.when(lo == hi, F.lit(1)).otherwise(F.width_bucket(F.col("v").cast("double"), lo, hi, F.lit(bins)))
    placed = x.crossJoin(F.broadcast(edges)).withColumn("bin", bin_)
    counts = placed.groupBy("bin", "total").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("before", F.sum("n").over(Window.orderBy("bin")) - F.col("n"))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.floor((F.col("total") - 1) * F.lit(p)).alias("rank")) for i, p in enumerate(probabilities)])
    wanted = upto.withColumn("r", F.explode(ranks)).filter("r.rank >= before and r.rank < before + n").select("bin", "before", "r.i", "r.rank")
    within = placed.join(F.broadcast(wanted), "bin").groupBy("i", "rank", "before", "v").agg(F.count(F.lit(1)).alias("n"))
    running = within.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("i").orderBy("v")))
    found = running.filter("upto > rank").groupBy("i").agg(F.min("v").alias("v"))
    at = [F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"q{round(100 * p)}") for i, p in enumerate(probabilities)]
    ends = edges.select(F.col("lo").alias("least"), F.col("hi").alias("greatest"))
    names = [f"q{round(100 * p)}" for p in probabilities]
    return found.agg(*at).crossJoin(F.broadcast(ends)).select("least", *names, "greatest")


def histogram(df: DataFrame, value: str, bins: int = 25) -> DataFrame:
    """(bin, n) for equal bins between least and greatest value, which falls into the last bin."""
    x = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    edges = x.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    bin_ = F.when(F.col("lo") == F.col("hi"), 1).otherwise(F.least(F.width_bucket("v", "lo", "hi", F.lit(bins)), F.lit(bins)))
    return x.crossJoin(F.broadcast(edges)).select(bin_.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def box_plot(df: DataFrame, value: Column, *keys: str) -> DataFrame:
    """Quartiles and the whiskers: the outermost values within 1.5 times the interquartile range."""
    x = df.withColumn("_x", value).filter("_x is not null")
    quartiles = x.groupBy(*keys).agg(F.percentile("_x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = [F.get("q", F.lit(i)) for i in range(3)]
    bounds = quartiles.select(*keys, q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), (q[0] - 1.5 * (q[2] - q[0])).alias("_lo"), (q[2] + 1.5 * (q[2] - q[0])).alias("_hi"))
    joined = x.join(bounds, list(keys)) if keys else x.crossJoin(F.broadcast(bounds))
    inside = (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))
    return joined.groupBy(*keys, "q1", "median", "q3").agg(F.min(F.when(inside, F.col("_x"))).alias("low"), F.max(F.when(inside, F.col("_x"))).alias("high"))


def top(counts: DataFrame, n: int, *tie: str, by: str = "n") -> DataFrame:
    """The n rows with the highest count, ties by the given columns: a top-k, not a full sort."""
    return counts.orderBy(F.desc(by), *tie).limit(n)
