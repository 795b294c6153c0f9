"""Kinematics of object tracks as ordered windows.

Input: one row a sighting with obj, t, ord (breaks ties in time) and box. Windows run by object in order of time, which
Spark streams and spills; nothing collects a track into one row. Descriptors are then plain aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions import geometry as G


def steps(obs: DataFrame, keys: tuple[str, ...] = ("obj",)) -> DataFrame:
    """obs with cx, cy, and for the step to the next sighting (null for the last) dx, dy, dist, dt and speed; speed_up
    is the change of speed from the step before, turn the dot product with it."""
    by = Window.partitionBy(*keys).orderBy("t", "ord")
    df = obs.withColumns({"cx": G.centroid(F.col("box"))["x"], "cy": G.centroid(F.col("box"))["y"], "diag": G.diagonal(F.col("box")), "area": G.area(F.col("box"))})
    df = df.withColumns({"dx": F.lead("cx").over(by) - F.col("cx"), "dy": F.lead("cy").over(by) - F.col("cy"), "dt": F.lead("t").over(by) - F.col("t"), "seq": F.row_number().over(by)})
    df = df.withColumn("dist", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    df = df.withColumn("speed", F.when(F.col("dt").isNotNull(), F.when(F.col("dt") > 0, F.col("dist") / F.col("dt")).otherwise(0.0)))
    return df.withColumns({"speed_up": F.col("speed") - F.lag("speed").over(by), "turn": F.col("dx") * F.lag("dx").over(by) + F.col("dy") * F.lag("dy").over(by)})


def summary(obs: DataFrame, keys: tuple[str, ...] = ("obj",)) -> DataFrame:
    """One row a track: the sums that the descriptor is made of."""
    df = steps(obs, keys)
    order = F.struct("t", "ord")
    moves = F.col("dist") >= 1e-9
    bins = G.compass(F.col("dx"), F.col("dy"))
    df = df.withColumn("bin", F.when(moves, bins))
    votes = [F.struct(F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("dist"))), F.lit(0.0)).alias("v"), (-F.coalesce(F.min(F.when(F.col("bin") == b, F.col("seq"))), F.lit(2147483647))).alias("first"), F.lit(b).alias("bin")) for b in G.COMPASS]
    first, last = (lambda c: F.min_by(c, order)), (lambda c: F.max_by(c, order))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("dist"), F.lit(0.0)).alias("path"),
        (F.max("t") - F.min("t")).alias("seconds"),
        F.avg("diag").alias("diag"),
        F.sqrt(F.pow(last("cx") - first("cx"), F.lit(2)) + F.pow(last("cy") - first("cy"), F.lit(2))).alias("net"),
        first("area").alias("area_first"),
        last("area").alias("area_last"),
        F.count_if(F.col("turn") < 0).alias("reversals"),
        F.count_if(F.col("speed_up") > 0.005).alias("faster"),
        F.count_if(F.col("speed_up") < -0.005).alias("slower"),
        F.max("speed").alias("speed_max"),
        F.min("speed_up").alias("drop"),
        F.max("speed_up").alias("rise"),
        F.sum(F.when(moves, F.col("dist"))).alias("moved"),
        F.greatest(*votes)["bin"].alias("lead"),
    )


def descriptor(obs: DataFrame, keys: tuple[str, ...] = ("obj",)) -> DataFrame:
    """One row a track: n, dir, speed, scale, shape, phase."""
    df = summary(obs, keys)
    n, moved = F.col("n"), F.coalesce("moved", F.lit(0.0))
    still = (n < 2) | (moved < 0.02 * F.col("diag")) | F.col("lead").isNull() | (moved == 0)
    pace = F.when((F.col("seconds") > 0) & (F.col("diag") > 1e-9), F.col("path") / F.col("seconds") / F.col("diag")).otherwise(0.0)
    slow = G.speed_bin(pace) == "stationary"
    df = df.withColumn("dir", F.when(still | slow, "STAT").otherwise(F.col("lead")))
    df = df.withColumn("speed", F.when(F.col("dir") == "STAT", "stationary").otherwise(G.speed_bin(pace)))
    df = df.withColumn("scale", F.when(n < 2, "stable").otherwise(G.scale_bin(F.col("area_first"), F.col("area_last"))))
    turns = F.col("reversals") / F.greatest(F.lit(1), n - 2)
    shape = F.when(F.col("path") < 1e-9, "stationary").when(turns > 0.4, "oscillating").when(F.col("net") / F.col("path") > 0.85, "linear").otherwise("curved")
    df = df.withColumn("shape", F.when(n >= 3, shape).otherwise(F.when(F.col("dir") == "STAT", "stationary").otherwise("linear")))
    diffs = n - 2
    half = 0.5 * F.col("speed_max")
    phase = F.when((F.col("drop") < -half) & (F.col("rise") > half), "reversing")
    phase = phase.when((F.col("faster") > 0.6 * diffs) & (F.col("slower") <= 0.2 * diffs), "accelerating").when((F.col("slower") > 0.6 * diffs) & (F.col("faster") <= 0.2 * diffs), "decelerating").otherwise("constant")
    df = df.withColumn("phase", F.when(n >= 3, phase).otherwise("constant"))
    return df.select(*keys, "n", "dir", "speed", "scale", "shape", "phase")


def acceleration(obs: DataFrame, keys: tuple[str, ...] = ("obj",)) -> DataFrame:
    """(last speed - first speed) / time of all timed steps; null under two timed steps."""
    df = steps(obs, keys).filter("dt > 0")
    order = F.struct("t", "ord")
    value = (F.max_by("speed", order) - F.min_by("speed", order)) / F.sum("dt")
    return df.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 2, value).alias("accel"), F.avg("speed").alias("mean_speed"))


def smoothness(obs: DataFrame, fps: float = 30.0, most: float = 500.0, keys: tuple[str, ...] = ("obj",)) -> DataFrame:
    """The mean share by which steps exceed `most` pixels a second, at most 1 each."""
    limit = most / fps
    # greatest() passes over nulls: the last sighting has no step.
    over = F.when(F.col("dist").isNotNull(), F.least(F.greatest(F.col("dist") - limit, F.lit(0.0)) / limit, F.lit(1.0)))
    return steps(obs, keys).groupBy(*keys).agg(F.coalesce(F.avg(over), F.lit(0.0)).alias("penalty"))


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(back)).filter("_r = 1").drop("_r")
