"""Roll-up of grounded question answering: answers, intervals and boxes of two chains, overall and by duration and domain.

Items have score (a judge's 0 to 3, -1 where it gave none, null where nothing was answered), timestamps (start, end), bboxes
array<struct<timestamp, xmin, ymin, xmax, ymax>>, frame_count, fps, domain, and for each chain (the second with the suffix
_2) answer_temporal array<double>, answer_temporal_pre (its text) and answer_spatial map<string, array<double>>.

Defined results: an item without an answer counts only among all items of the overall row; an empty interval is read from its
text, a null one is 0; a gold frame without a predicted box of four numbers counts 0, an item without gold frames 0; a
duration or domain without any answered item has no row; a log gap of a mean of 1 is null; a null domain is `unknown`.

Scale: one projection and one aggregation with grouping sets over bits and numbers, combined before the exchange; the lists
of items that meet a condition are rows, not lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.functions import geometry as G
from kinespark.functions import parse as P
from kinespark.functions.evidence import strip

from .rollup import grouping_sets

#: Thresholds of recall and precision, and what counts as right; fixed values.
RECALLS, PRECISIONS = (0.3, 0.5, 0.7), (0.1, 0.3, 0.5, 0.7, 0.9)
RIGHT, LONG_ENOUGH, WIDE_ENOUGH = 2, 0.3, 0.1
CHAINS = ("", "_2")
#: Conditions by the bits of what must hold: answer 1, interval 2, boxes 4.
CONDITIONS = {"vqa_temp": 3, "vqa_spat": 5, "temp_spat": 6, "vqa_temp_spat": 7}


def stated_interval(text: Column) -> Column:
    """The two numbers that a text (or its answer block) states, minutes and seconds as seconds; empty if not two."""
    said = F.coalesce(strip(P.block(text, "answer")), text, F.lit(""))
    clocks = F.regexp_extract_all(said, F.lit("(\\d+:\\d+)"), F.lit(1))
    seconds = lambda t: F.split(t, ":")[0].cast("bigint") * 60 + F.split(t, ":")[1].cast("bigint")
    plain = F.aggregate(clocks, said, lambda a, t: F.replace(a, t, F.concat(F.lit("<t>"), seconds(t).cast("string"), F.lit("</t>s"))))
    numbers = F.transform(F.regexp_extract_all(plain, F.lit("\\b\\d+(?:\\.\\d+)?\\b"), F.lit(0)), lambda x: x.cast("double"))
    return F.get(F.transform(F.array(numbers), lambda n: F.when(F.size(n) == 2, n).otherwise(F.array().cast("array<double>"))), 0)


def _overlap(gold: Column, answer: Column) -> Column:
    at = lambda a, k: F.get(a, F.lit(k))
    return F.when(F.coalesce(F.size(answer), F.lit(0)) == 2, G.interval_iou(at(answer, 0), at(answer, 1), at(gold, 0), at(gold, 1))).otherwise(F.lit(0.0))


def _boxes(gold: Column, answer: Column) -> Column:
    """The overlap at each gold frame."""
    box = lambda b: F.array(*[b[k].cast("double") for k in ("xmin", "ymin", "xmax", "ymax")])
    # Both boxes are bound first: their overlap names each of them many times.
    both = F.transform(gold, lambda b: F.struct(F.try_element_at(answer, b["timestamp"].cast("string")).alias("p"), box(b).alias("g")))
    found = F.transform(both, lambda z: F.coalesce(G.iou_clamped(z["p"], z["g"]), F.lit(0.0)))
    # A null or empty answer has no frames, but its gold frames count.
    return F.coalesce(F.when(F.coalesce(F.size(answer), F.lit(0)) > 0, found).otherwise(F.transform(gold, lambda b: F.lit(0.0))), F.array().cast("array<double>"))


def _share(values: Column, least: float) -> Column:
    """The share of an array's values that are `least` or more; 0 for none."""
    n = F.size(values)
    return F.when(n > 0, F.size(F.filter(values, lambda x: x >= least)) / n).otherwise(F.lit(0.0))


def measured(items: DataFrame) -> DataFrame:
    """items with duration, domain, answered, right, and for each chain tiou, ious, miou, aps and the bits that hold; rand_tiou."""
    out = items.withColumns({"duration": G.duration_bucket(F.col("frame_count"), F.col("fps")), "domain": F.coalesce("domain", F.lit("unknown")), "answered": F.col("score").isNotNull()})
    length = F.round(F.col("frame_count") / F.col("fps"), 2)
    out = out.withColumn("rand_tiou", _overlap(F.col("timestamps"), F.array(F.lit(0.0), length)))
    for c in CHAINS:
        answer = F.when(F.size(f"answer_temporal{c}") == 0, stated_interval(F.col(f"answer_temporal_pre{c}"))).otherwise(F.col(f"answer_temporal{c}"))
        # A generator keeps what is read; a projection would read it again wherever it is named.
        out = out.select("*", F.inline(F.array(F.struct(answer.alias("_answer"), _boxes(F.col("bboxes"), F.col(f"answer_spatial{c}")).alias(f"ious{c}")))))
        out = out.select("*", F.inline(F.array(F.struct(_overlap(F.col("timestamps"), F.col("_answer")).alias(f"tiou{c}"), G.mean(F.col(f"ious{c}")).alias(f"miou{c}"))))).drop("_answer")
        aps = [_share(F.col(f"ious{c}"), t) for t in PRECISIONS]
        bits = F.when(F.col("score") >= RIGHT, 1).otherwise(0) + F.when(F.col(f"tiou{c}") >= LONG_ENOUGH, 2).otherwise(0) + F.when(F.col(f"miou{c}") >= WIDE_ENOUGH, 4).otherwise(0)
        out = out.withColumns({f"aps{c}": F.array(*aps), f"bits{c}": F.when(F.col("answered"), bits)})
    return out


def _log_gap(*means: Column) -> Column:
    return -sum(F.ln(1 - m) for m in means) / len(means)


def statistics(held: DataFrame) -> DataFrame:
    """Each row of overall, duration and domain: dimension, value, and all figures, from `measured` items."""
    answered = F.col("answered")
    mean = lambda c: F.avg(F.when(answered, c))
    aggs = [F.count(F.lit(1)).alias("items"), F.count_if(answered).alias("answered")]
    aggs += [mean(F.greatest(F.col("score"), F.lit(0))).alias("all_score"), F.coalesce(F.avg(F.when(F.col("score") != -1, F.col("score"))), F.lit(0.0)).alias("valid_score"), F.count_if(F.col("score") >= RIGHT).alias("_right"), mean(F.col("rand_tiou")).alias("rand_tiou")]
    for c in CHAINS:
        tiou = F.col(f"tiou{c}")
        aggs += [mean((tiou >= t).cast("double")).alias(f"r1_{int(t * 100)}{c}") for t in RECALLS] + [mean(tiou).alias(f"tiou{c}")]
        aggs += [mean(F.col(f"aps{c}")[k]).alias(f"ap_{int(t * 100)}{c}") for k, t in enumerate(PRECISIONS)] + [mean(F.col(f"miou{c}")).alias(f"miou{c}")]
        aggs += [F.count_if(F.col(f"bits{c}").bitwiseAND(F.lit(b)) == b).alias(f"_{n}{c}") for n, b in CONDITIONS.items()]
    out = grouping_sets(held, ["duration", "domain"], aggs).filter("answered > 0")
    total = F.when(F.col("dimension") == "overall", F.col("items")).otherwise(F.col("answered"))
    out = out.withColumn("accuracy", F.col("_right") / total)
    for c in CHAINS:
        out = out.withColumns({f"{n}{c}": F.col(f"_{n}{c}") / total for n in CONDITIONS})
        parts = [F.col("accuracy"), F.col(f"tiou{c}"), F.col(f"miou{c}")]
        out = out.withColumns({f"am{c}": sum(parts) / 3, f"lgm{c}": _log_gap(*parts)})
    out = out.withColumns({"mam": (F.col("am") + F.col("am_2")) / 2, "mlgm": (F.col("lgm") + F.col("lgm_2")) / 2})
    return out.drop("_right", *[f"_{n}{c}" for n in CONDITIONS for c in CHAINS])


def meeting(held: DataFrame, key: str) -> DataFrame:
    """(chain, condition, key): a row for each condition of each chain that an item meets."""
    kinds = F.array(*[F.struct(F.lit(k + 1).alias("chain"), F.lit(n).alias("condition"), (F.col(f"bits{c}").bitwiseAND(F.lit(b)) == b).alias("meets")) for k, c in enumerate(CHAINS) for n, b in CONDITIONS.items()])
    return held.select(key, F.explode(kinds).alias("_c")).filter("_c.meets").select("_c.chain", "_c.condition", key)
