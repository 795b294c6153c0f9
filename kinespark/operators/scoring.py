"""Scores of completions as columns, by name; a score is a function of a frame's columns that gives a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.functions import geometry as G
from kinespark.functions import parse as P

SCORES: dict[str, Callable[..., Column]] = {}
W_DIR, W_SPEED, W_SCALE = 0.40, 0.30, 0.30
MOTION_TASKS = ("temporal-spatial free-form QA", "General video QA Free-form", "General video QA MCQ")


def register_score(name: str):
    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        SCORES[name] = f
        return f

    return add


def with_scores(df: DataFrame, names: list[str], **columns: Column) -> DataFrame:
    """df with r_<name> for each score and their sum r_total."""
    made = {f"r_{n}": SCORES[n](**columns) for n in names}
    return df.withColumns(made).withColumn("r_total", G.total([F.col(c) for c in made]))


def _count(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


@register_score("ans_acc")
def answer_accuracy(content: Column, gold: Column, **_: Column) -> Column:
    """1 if the answer is the gold letter alone, with a period, in brackets or both."""
    answer = P.block(content, "answer")
    forms = [gold, F.concat(gold, F.lit(".")), F.concat(F.lit("("), gold, F.lit(")")), F.concat(F.lit("["), gold, F.lit("]"))]
    return F.when(F.coalesce(F.array_contains(F.array(*forms), answer), F.lit(False)), 1.0).otherwise(0.0)


@register_score("ans_tiou")
def answer_interval(content: Column, start: Column, end: Column, **_: Column) -> Column:
    """Overlap of the answered interval with the gold one; 0 if it runs backwards or is missing."""
    pattern = "<t>([\\d.]+)</t>s to <t>([\\d.]+)</t>s"
    answer = P.block(content, "answer")
    a, b = F.regexp_extract(answer, pattern, 1).try_cast("double"), F.regexp_extract(answer, pattern, 2).try_cast("double")
    return F.coalesce(F.when(b >= a, G.interval_iou(a, b, start, end)), F.lit(0.0))


@register_score("ans_viou")
def answer_box(content: Column, box: Column, **_: Column) -> Column:
    found = F.from_json(F.regexp_extract(P.block(content, "answer"), "(\\[.*?\\])", 1), "array<double>")
    return F.coalesce(G.iou_clamped(found, box), F.lit(0.0))


def _times(content: Column) -> Column:
    return F.array_compact(F.transform(F.regexp_extract_all(P.block(content, "think"), F.lit("<t>([^<]*)</t>"), F.lit(1)), lambda t: t.try_cast("double")))


@register_score("thk_temporal_point")
def thought_times(content: Column, times: Column, progress: Column, **_: Column) -> Column:
    """The mean closeness of thought times to the nearest gold time."""
    near = F.transform(_times(content), lambda t: G.proximity(G.nearest(times, t), progress))
    return F.coalesce(G.mean(near), F.lit(0.0))


@register_score("thk_temporal_segment")
def thought_inside(content: Column, start: Column, end: Column, **_: Column) -> Column:
    """The share of thought times within the gold interval."""
    return F.coalesce(G.mean(F.transform(_times(content), lambda t: t.between(start, end).cast("double"))), F.lit(0.0))


@register_score("thk_spatial")
def thought_boxes(content: Column, boxes: Column, **_: Column) -> Column:
    """The mean over claims of their best overlap with gold boxes."""
    best = F.transform(P.claims(content), lambda c: F.coalesce(F.array_max(F.transform(c["boxes"], lambda b: G.best_iou(b, boxes))), F.lit(0.0)))
    return G.mean(best)


@register_score("motion_tag")
def motion_attributes(content: Column, dir: Column, speed: Column, scale: Column, **_: Column) -> Column:
    """Weighted agreement of the last motion tag with the gold bins; without one, of the sentence's direction alone."""
    tags = P.motion_tags(content)
    tag = F.get(tags, F.size(tags) - 1)
    full = W_DIR * G.direction_score(tag["dir"], dir) + W_SPEED * G.ordinal_score(tag["speed"], speed, G.SPEEDS) + W_SCALE * G.ordinal_score(tag["scale"], scale, G.SCALES)
    word = P.compass_word(content)
    only = F.when(word.isNotNull(), W_DIR * G.direction_score(word, dir) + (W_SPEED + W_SCALE) * 0.25).otherwise(0.0)
    return F.when(F.size(tags) > 0, full).otherwise(only)


@register_score("motion_words")
def motion_words(content: Column, word: Column, speed_ratio: Column, **_: Column) -> Column:
    """Half for the direction word, half for the ratio of speeds."""
    return 0.5 * F.when(P.direction_word(content) == word, 1.0).otherwise(0.0) + 0.5 * speed_ratio


@register_score("motion_grounding")
def motion_grounding(dir: Column, speed: Column, scale: Column, masked_dir: Column, masked_speed: Column, masked_scale: Column, **_: Column) -> Column:
    """How much the motion bins change when the object is masked; 1 where the masked output has none."""
    changed = lambda a, b: F.when(F.coalesce(a != b, F.lit(True)), 1.0).otherwise(0.0)
    return 0.5 * changed(dir, masked_dir) + 0.3 * changed(speed, masked_speed) + 0.2 * changed(scale, masked_scale)


@register_score("format")
def format_score(content: Column, task: Column, **_: Column) -> Column:
    """0 without paired think and answer tags or with odd tags in the thought; 1 with the grounding the task asks for,
    else a half. Self-closing motion tags count as motion."""
    # Bound once: a plain column would be parsed anew wherever it is named.
    parts = F.struct(P.block(content, "think").alias("think"), P.block(content, "answer").alias("answer"))
    return F.get(F.transform(F.array(parts), lambda x: _format(content, task, x["think"], x["answer"])), 0)


def _format(content: Column, task: Column, think: Column, answer: Column) -> Column:
    paired = lambda t, where: _count(where, f"<{t}>") == _count(where, f"</{t}>")
    ok = think.isNotNull() & answer.isNotNull() & paired("think", content) & paired("answer", content)
    for t in ("obj", "t", "box", "motion"):
        ok = ok & F.coalesce(paired(t, think), F.lit(False))
    n = lambda t: F.coalesce(_count(think, f"<{t}>"), F.lit(0.0))
    grounded = (n("obj") > 0) & (n("t") > 0) & (n("box") > 0)
    grounded = F.when(task.isin("temporal QA", "temporal QA (MCQ)"), n("t") >= 2).when((task == "visual QA") & content.rlike("<obj>(\\w+)</obj><box>(\\[.*?\\])</box>"), True).otherwise(grounded)
    motion = (n("motion") > 0) | (F.size(P.motion_tags(content)) > 0)
    grounded = grounded & (~task.isin(*MOTION_TASKS) | motion)
    return F.when(~ok, 0.0).when(grounded | task.contains("General video QA"), 1.0).otherwise(0.5)


def weighted(name: str, weight: float) -> Callable[..., Column]:
    """A score with its weight bound."""
    return lambda **columns: weight * SCORES[name](**columns)


