"""The composite score of evidence chains: predicted steps, parsed from text, against gold steps in order.

Gold steps are array<struct<t_s, t_e, bbox array<double>, displacements array<array<double>>, caption>>. Steps are paired by
place, as many as the shorter side has. Four components are means over pairs: boxes (the first predicted one, over pairs
that have both), intervals (all pairs), motion (pairs with two predicted boxes or more and gold displacements) and captions (all
pairs). Their weighted sum is kept within 0 and 1.

Defined results: without gold steps all components are 0; a gold time that is null is 0 or 1; a caption without words
scores 0 for shared words; null texts are empty ones. Texts and steps stay in their rows: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.functions import evidence as E
from kinespark.functions import geometry as G
from kinespark.functions.parse import bound
from kinespark.functions.text import closeness, tokens

#: Weights of the components, and within motion and captions; fixed values.
WEIGHTS = {"spatial": 0.25, "temporal": 0.15, "motion": 0.35, "caption": 0.20}
DIRECTION, SPEED, SMOOTH, WORDS, LETTERS = 0.4, 0.4, 0.2, 0.6, 0.4
FPS, MOST_SPEED = 30.0, 500.0


def _mean(values: Column) -> Column:
    """The mean of an array without its nulls; 0 for none."""
    return F.coalesce(F.get(F.transform(F.array(F.array_compact(values)), lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(v), F.lit(0))), 0), F.lit(0.0))


def _moves(boxes: Column) -> Column:
    """array<struct<x, y>>: the displacements of boxes' centroids."""
    n = lambda c: F.greatest(F.size(c) - 1, F.lit(0))
    return bound(F.transform(boxes, G.centroid), lambda c: F.zip_with(F.slice(c, 1, n(c)), F.slice(c, 2, n(c)), lambda a, b: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y"))))


def _length(v: Column) -> Column:
    return F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])


def _pairs(a: Column, b: Column) -> Column:
    """Two arrays side by side, as far as the shorter one goes."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, 1, n).alias("p"), F.slice(b, 1, n).alias("g"))


def _cosine(z: Column) -> Column:
    p, g = _length(z["p"]), _length(z["g"])
    return F.when((p > 0) & (g > 0), ((z["p"]["x"] * z["g"]["x"] + z["p"]["y"] * z["g"]["y"]) / (p * g) + 1) / 2)


def _fidelity(z: Column) -> Column:
    p, g = _length(z["p"]), _length(z["g"])
    return F.when((p == 0) & (g == 0), 1.0).when((p == 0) | (g == 0), 0.0).otherwise(F.least(p, g) / F.greatest(p, g))


def _motion(pairs: Column, fps: float) -> Column:
    most = MOST_SPEED / fps
    gold = lambda g: F.transform(F.coalesce(g["displacements"], F.array().cast("array<array<double>>")), lambda v: F.struct(F.get(v, 0).alias("x"), F.get(v, 1).alias("y")))
    # One box makes no move.
    moving = F.filter(pairs, lambda z: F.size(z["p"]["boxes"]) > 1)
    both = F.transform(moving, lambda z: F.struct(_moves(z["p"]["boxes"]).alias("p"), gold(z["g"]).alias("g")))
    both = F.filter(both, lambda m: (F.size(m["p"]) > 0) & (F.size(m["g"]) > 0))

    def scored(m: Column) -> Column:
        z = _pairs(m["p"], m["g"])
        jumps = F.transform(m["p"], lambda v: F.least(F.greatest((_length(v) - most) / most, F.lit(0.0)), F.lit(1.0)))
        return DIRECTION * _mean(F.transform(z, _cosine)) + SPEED * _mean(F.transform(z, _fidelity)) + SMOOTH * (1 - _mean(jumps))

    return _mean(F.transform(both, scored))


def _caption(z: Column) -> Column:
    def scored(c: Column) -> Column:
        words = F.struct(F.array_distinct(tokens(c["said"])).alias("a"), F.array_distinct(tokens(c["gold"])).alias("b"))
        sizes = bound(words, lambda w: F.struct(F.size(F.array_intersect(w["a"], w["b"])).alias("shared"), (F.size(w["a"]) + F.size(w["b"])).alias("all")))
        return WORDS * bound(sizes, lambda n: F.when(n["shared"] > 0, 2.0 * n["shared"] / n["all"]).otherwise(0.0)) + LETTERS * closeness(c["said"], c["gold"])

    return bound(F.struct(F.coalesce(z["p"]["description"], F.lit("")).alias("said"), F.coalesce(z["g"]["caption"], F.lit("")).alias("gold")), scored)


def components(pairs: Column, fps: float = FPS) -> dict[str, Column]:
    """spatial, temporal, motion and caption of parsed steps and gold steps side by side."""
    boxed = F.filter(pairs, lambda z: (F.size(z["p"]["boxes"]) > 0) & (F.size(z["g"]["bbox"]) == 4))
    return {
        "spatial": _mean(F.transform(boxed, lambda z: bound(F.struct(F.get(z["p"]["boxes"], 0).alias("p"), z["g"]["bbox"].alias("g")), lambda b: G.iou(b["p"], b["g"])))),
        "temporal": _mean(F.transform(pairs, lambda z: G.interval_iou(z["p"]["start"], z["p"]["end"], F.coalesce(z["g"]["t_s"], F.lit(0.0)), F.coalesce(z["g"]["t_e"], F.lit(1.0))))),
        "motion": _motion(pairs, fps),
        "caption": _mean(F.transform(pairs, _caption)),
    }


def composite(df: DataFrame, text: str, gold: str, weights: dict[str, float] | None = None, fps: float = FPS) -> DataFrame:
    """df with spatial, temporal, motion, caption and score, from a column of model output and one of gold steps."""
    weights = weights or WEIGHTS
    # A generator keeps the parsed steps as they are; a projection would be parsed again for each component.
    held = df.select("*", F.inline(F.array(F.struct(E.steps(F.col(text)).alias("_steps")))))
    held = held.select("*", F.inline(F.array(F.struct(_pairs(F.col("_steps"), F.coalesce(F.col(gold), F.array())).alias("_pairs")))))
    parts = components(F.col("_pairs"), fps)
    held = held.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in parts.items()]))))
    total = sum(w * F.col(n) for n, w in weights.items())
    score = F.when(F.size("_steps") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))).otherwise(0.0)
    return held.withColumn("score", score).drop("_steps", "_pairs")
