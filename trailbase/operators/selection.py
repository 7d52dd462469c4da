"""Exact order statistics of many groups by refining histograms.

A pass cuts an interval of values into bins and counts them, on the map side
first; the bin that holds a wanted rank, with its least and greatest value, is
the next interval.  An interval of one value is done.  Bins are equal steps, or
equal ratios where the interval spans orders of magnitude, and zero and the
infinities have bins of their own, so a handful of passes is enough for any
doubles.  What is exchanged is at most BINS rows for a task, group and wanted
rank; no task holds the values of a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import delete_at_exit, keep, shared_folder

BINS = 4096
#: An interval whose ends are further apart than this (as a ratio) is cut by ratios.
WIDE = 2.0**12
INFINITE = float("inf")


def _bin(v: Column, low: Column, high: Column) -> Column:
    """A number that never falls as v rises within [low, high], and differs at the two ends."""
    part = lambda x, a, b: F.when(b - a == INFINITE, (x / 2 - a / 2) / (b / 2 - a / 2)).otherwise((x - a) / (b - a))
    step = lambda x, a, b: F.least(F.floor(part(x, a, b) * BINS), F.lit(BINS - 1))
    ratio = lambda x, a, b: step(F.log2(x), F.log2(a), F.log2(b))
    sign = F.signum(v).cast("long")
    cut = (
        F.when((low <= 0) & (high >= 0), sign)
        .when((low > 0) & (high / low > WIDE), ratio(v, low, high))
        .when((high < 0) & (low / high > WIDE), -ratio(-v, -high, -low))
        .otherwise(step(v, low, high))
    )
    return F.when(v == -INFINITE, -BINS - 1).when(v == INFINITE, BINS + 1).when((low == -INFINITE) | (high == INFINITE), sign).otherwise(cut).cast("int")


def at_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """For each group (columns ``by``, none null), n and, for each name, the value at a 0-based rank of ascending order.

    ranks: columns over n, the number of values; a rank outside 0 to n - 1 gives
    null.  Nulls and NaN are left out; a group without values has no row.
    """
    spark = rows.sparkSession
    path = shared_folder(spark, "selection")
    delete_at_exit(spark, path)
    wanted_names = list(ranks)
    keys = [f"g{i}_" for i in range(len(by))]
    values = rows.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)").select(F.struct(F.lit(0).alias("all_"), *keys).alias("g_"), (F.col("v") + 0.0).alias("v"))  # -0.0 becomes 0.0
    values = keep(values, f"{path}/values")
    sizes = keep(values.groupBy("g_").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), f"{path}/sizes")
    asked = sizes.select("g_", "n", "low", "high", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), c.cast("long").alias("rank")) for k, c in ranks.items()])).alias("w"))
    open_ = asked.select("g_", "w.name", "w.rank", F.lit(0).cast("long").alias("before"), "low", "high").filter("rank >= 0 and rank < n")
    open_, done, number = keep(open_, f"{path}/open0"), [], 0
    while True:
        done.append(open_.filter("low = high").select("g_", "name", F.col("low").alias("value")))
        left = open_.filter("low < high")
        if left.isEmpty():
            break
        number += 1
        intervals = left.groupBy("g_").agg(F.collect_set(F.struct("low", "high")).alias("intervals"))  # as many as ranks, at most
        own = values.join(intervals, "g_").select("g_", "v", F.explode(F.filter("intervals", lambda i: (F.col("v") >= i["low"]) & (F.col("v") <= i["high"]))).alias("i"))
        own = own.select("g_", "i.low", "i.high", "v", _bin(F.col("v"), F.col("i.low"), F.col("i.high")).alias("bin"))
        bins = own.groupBy("g_", "low", "high", "bin").agg(F.count("*").alias("rows"), F.min("v").alias("least"), F.max("v").alias("most"))
        order = Window.partitionBy("g_", "low", "high").orderBy("bin")  # of bins, not of values
        bins = bins.withColumn("upto", F.sum("rows").over(order))
        found = left.join(bins, ["g_", "low", "high"]).filter((F.col("rank") >= F.col("before") + F.col("upto") - F.col("rows")) & (F.col("rank") < F.col("before") + F.col("upto")))
        open_ = keep(found.select("g_", "name", "rank", (F.col("before") + F.col("upto") - F.col("rows")).alias("before"), F.col("least").alias("low"), F.col("most").alias("high")), f"{path}/open{number}")
    every = reduce(DataFrame.unionByName, done).groupBy("g_").agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in wanted_names])
    return sizes.select("g_", "n").join(every, "g_", "left").select(*[F.col("g_")[k].alias(b) for b, k in zip(by, keys, strict=True)], "n", *wanted_names)


def percentiles(rows: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact percentiles of each group with linear interpolation, and its greatest value (max)."""
    place = {k: (F.col("n") - 1) * F.lit(float(p)) for k, p in points.items()}
    ranks = {f"{k}_{end}": f(place[k]) for k in points for end, f in (("low", F.floor), ("high", F.ceil))} | {"max": F.col("n") - 1}
    found = at_ranks(rows, by, value, ranks)
    mixed = lambda k: F.col(f"{k}_low") + F.when(F.col(f"{k}_high") == F.col(f"{k}_low"), 0.0).otherwise((F.col(f"{k}_high") - F.col(f"{k}_low")) * (place[k] - F.floor(place[k])))
    return found.select(*by, *[mixed(k).alias(k) for k in points], "max")


def discrete_percentiles(rows: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Of each group the least value that so many of its values don't pass, for each point."""
    ranks = {k: F.greatest(F.ceil(F.col("n") * F.lit(float(p))) - 1, F.lit(0)) for k, p in points.items()}
    return at_ranks(rows, by, value, ranks).select(*by, *points)
