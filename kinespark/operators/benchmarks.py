"""Benchmark entries: categories by name, questions with their gold answers, ratings by several slices, tag quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.functions.evidence import strip


def resolved(asked: DataFrame, name: str, known: DataFrame, aliases: dict[str, str], out: str = "category") -> DataFrame:
    """asked with the category that a name stands for: of that name, by an alias in upper case, else the first (by `place`)
    that holds the name in any case; the name itself where there is none, null for a null name.

    A dictionary's names are short, so all their parts are keys of their own: the search is a join by equality.
    """
    low = F.lower("category")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - i + 1, F.lit(1))), lambda n: F.substring(low, i, n))))
    held = known.select("category", "place", F.explode(F.array_distinct(F.concat(parts, F.array(F.lit(""))))).alias("_part"))
    held = held.groupBy("_part").agg(F.min_by("category", "place").alias("_within"))
    exact = known.select(F.col("category").alias("_exact")).distinct()
    alias = F.coalesce(*[F.when(F.upper(name) == a, c) for a, c in aliases.items()], F.lit(None).cast("string"))
    df = asked.join(exact, F.col(name) == F.col("_exact"), "left").join(held, F.lower(name) == F.col("_part"), "left")
    return df.withColumn(out, F.coalesce("_exact", alias, "_within", F.col(name))).drop("_exact", "_part", "_within")


def questions(entries: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """A row for each question of entries (key, question_type, video_path, qa array<struct<uid, answer, question>>) that has
    a gold answer (not empty, not NA in any case) and a text, of the categories if any are given.

    The question's own lines and its options, `X. text` lines as array<struct<letter, text>>, come apart.
    """
    held = entries.filter(F.coalesce("question_type", F.lit("")).isin(*categories)) if categories else entries
    held = held.select("key", F.coalesce("question_type", F.lit("")).alias("question_type"), F.coalesce("video_path", F.concat(F.coalesce("key", F.lit("")), F.lit(".mp4"))).alias("video"), F.inline("qa"))
    held = held.filter((F.coalesce("answer", F.lit("")) != "") & (F.upper("answer") != "NA") & (F.coalesce("question", F.lit("")) != ""))
    lines, form = F.split(strip(F.col("question")), "\n"), "^([A-Z])\\.\\s*(.*)"
    option = lambda x: strip(x).rlike(form)
    options = F.transform(F.filter(lines, option), lambda x: F.struct(F.regexp_extract(strip(x), form, 1).alias("letter"), F.regexp_extract(strip(x), form, 2).alias("text")))
    asked = strip(F.array_join(F.filter(lines, lambda x: ~option(x)), "\n"))
    return held.select("key", F.coalesce("uid", F.lit("")).alias("uid"), "question_type", "video", asked.alias("question"), options.alias("options"), F.upper(strip(F.col("answer"))).alias("answer"))


def ratings(df: DataFrame, group: str, slices: list[str], classes: str, score: str) -> DataFrame:
    """(group, slice, value, rating): the mean of scores of 0 or more, to three places, of each value of each slice, of each
    of the array column `classes`, and overall; within each group, and over all groups as `overall`. nan without a score."""
    each = [F.struct(F.lit("overall").alias("slice"), F.lit(None).cast("string").alias("value"))]
    each += [F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in slices]
    more = F.transform(F.coalesce(classes, F.array().cast("array<string>")), lambda c: F.struct(F.lit(classes).alias("slice"), c.alias("value")))
    held = df.select(F.col(group).alias("_group"), F.col(score).alias("_score"), F.inline(F.concat(F.array(*each), more)))
    mean = F.avg(F.when(F.col("_score") >= 0, F.col("_score")))
    text = F.when(mean.isNull(), "nan").otherwise(F.format_string("%.3f", mean))
    out = held.groupingSets([[F.col("_group"), F.col("slice"), F.col("value")], [F.col("slice"), F.col("value")]], "_group", "slice", "value").agg(F.grouping("_group").alias("_all"), text.alias("rating"))
    return out.select(F.when(F.col("_all") == 1, "overall").otherwise(F.col("_group")).alias(group), "slice", "value", "rating")


def rating_report(rated: DataFrame, group: str) -> DataFrame:
    """(group, report): one JSON object for each group, of its slices' ratings by value. A report is as long as the lists of values."""
    by = rated.groupBy(group, "slice").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("value", F.lit("")), "rating"))).alias("m"))
    return by.groupBy(group).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("slice", "m")))).alias("report"))


def tag_quality(text: Column) -> list[Column]:
    """Aggregates over texts with <motion> sentences: samples, those with a sentence, sentences, and of them single frames,
    stationary and moving ones."""
    tags = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("<motion>([^<]+)</motion>"), F.lit(1))
    n = lambda keep: F.sum(F.size(F.filter(tags, keep)))
    single, still = (lambda t: t.contains("single frame")), (lambda t: t.contains("stationary"))
    return [
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.size(tags) > 0).alias("with_motion"),
        F.sum(F.size(tags)).alias("tags"),
        n(single).alias("single_frame"),
        n(lambda t: still(t) & ~single(t)).alias("stationary"),
        n(lambda t: ~still(t) & ~single(t)).alias("moving"),
    ]
