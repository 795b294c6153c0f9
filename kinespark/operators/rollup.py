"""Roll-ups of evaluation results: grouping sets, nearest-rank percentiles, votes, group-normalised scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def advantages(df: DataFrame, group: list[str], reward: str, floor: float = 1e-4) -> DataFrame:
    """df with advantage: a reward less its group's mean, over the group's sample deviation plus `floor`; null for a
    group of one."""
    w = Window.partitionBy(*group)
    return df.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_samp(reward).over(w) + floor))


def grouping_sets(df: DataFrame, dims: list[str], aggregates: list[Column]) -> DataFrame:
    """One row for each value of each dimension, and one overall: dimension, value and the aggregates, in one pass."""
    sets = [[F.col(d)] for d in dims] + [[]]
    out = df.groupingSets(sets, *dims).agg(F.grouping_id().alias("_gid"), *aggregates)
    full = 2 ** len(dims) - 1
    name = lambda k: full - 2 ** (len(dims) - 1 - k)
    which = F.coalesce(*[F.when(F.col("_gid") == name(k), d) for k, d in enumerate(dims)], F.lit("overall"))
    value = F.coalesce(*[F.when(F.col("_gid") == name(k), F.col(d).cast("string")) for k, d in enumerate(dims)])
    return out.withColumn("dimension", which).withColumn("value", value).drop("_gid", *dims)


def nearest_rank(df: DataFrame, keys: list[str], value: str, percents: list[int], splits: int = 64) -> DataFrame:
    """For each key and percent p the value at place min(floor(n p / 100), n - 1) of the sorted values.

    Equal values are counted before the shuffle. A key's values are cut at `splits` approximate quantiles, so that no task
    sorts a whole key; exact counts of the parts give each part's first place, wherever the cuts fall.
    """
    held = df.filter(F.col(value).isNotNull()).select(F.struct(*keys).alias("_k"), F.col(value).alias("_v"))
    cuts = held.groupBy("_k").agg(F.percentile_approx("_v", [k / splits for k in range(1, splits)], 1000).alias("_cuts"), F.count(F.lit(1)).alias("_n"))
    counts = held.groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_c")).join(cuts, "_k")
    counts = counts.withColumn("_part", F.size(F.filter("_cuts", lambda x: x < F.col("_v")))).drop("_cuts")
    before = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("_k", "_part").agg(F.sum("_c").alias("_held"))
    parts = parts.select("_k", "_part", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy("_k", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.join(parts, ["_k", "_part"]).withColumn("_end", F.col("_from") + F.sum("_c").over(within))
    place = lambda p: F.least(F.floor(F.col("_n") * p / 100), F.col("_n") - 1)
    holds = lambda p: (place(p) < F.col("_end")) & (place(p) >= F.col("_end") - F.col("_c"))
    out = placed.groupBy("_k").agg(*[F.max(F.when(holds(p), F.col("_v"))).alias(f"p{p}") for p in percents])
    return out.select("_k.*", *[f"p{p}" for p in percents])


def weighted_vote(df: DataFrame, keys: list[str], choice: str, weight: str) -> DataFrame:
    """The choice of the largest sum of weights for each key; the first by name on ties."""
    sums = df.groupBy(*keys, choice).agg(F.sum(weight).alias("_w"))
    order = Window.partitionBy(*keys).orderBy(F.col("_w").desc(), choice)
    return sums.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select(*keys, F.col(choice).alias("winner"), F.col("_w").alias("score"))


def cap_per_group(df: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")
