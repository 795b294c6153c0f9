"""Quality rules: per-document counts and cross-document line frequency (DataFrame functions only).

A line is normalised (lower case, white space to one space, digit runs to 0) and hashed. For each host (the
`source`), the distinct documents that hold the line are counted; lines above `share` of the host's documents (and
above `least`) are boilerplate and are taken out; a document that keeps less than `remain` of its words is depleted.
Documents are told apart by a hash of all their normalised lines that have words, in order: exact copies count once
(they are the near-dedup's business, not boilerplate), and documents that differ in any line are two, however much they
share.

Defined results: a null or empty text has no words, fails the base rule and isn't kept; a null source is a host of its
own; repeated rows count once for a line and each get their own result row; an empty table gives an empty result;
columns beyond doc_id, text and source, of whatever names, pass through `clean` and are ignored by `measure`; a line as
frequent as the limits (ties) stays; very long texts are counted whole.

Scale: the text is read once and never shuffled; the counts and line hashes (in `clean` with the texts that may stay) go
to the shared folder. What is shuffled are (host, line, document) hashes, combined before the exchange. A host has at
most `1 / share` times its mean lines a document of frequent lines; they come back as one array a host, by a join whose
form Spark chooses by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HAS_WORD, cut, hold, spaced, tuck, untuck, words

SHARE, LEAST, REMAIN = 0.05, 20, 0.3


def _windows(w: Column) -> Column:
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n >= 3, hashes).otherwise(F.array().cast("array<bigint>"))


def _normal_lines(text: Column) -> Column:
    """The lines of a text as they are compared, one for each line; '' for a line without words."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[0-9]+", "0")
    out = F.regexp_replace(out, "[\\x20\\t\\x0B\\f\\r]{2,}|[\\t\\x0B\\f\\r]", " ")
    return F.transform(F.split(out, "\n"), lambda x: F.trim(x))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and _lines: a hash and the
    number of words for each line (null: none), and _doc: a hash of the normalised text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = hold(docs, _w=words(F.col("text")), _l=F.split(text, "\n"), _m=_normal_lines(F.col("text")))
    out = hold(out, _h=_windows(F.col("_w")), _r=F.filter("_l", lambda x: x.rlike(HAS_WORD)))
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    pairs = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    out = hold(out, _s=F.when(twice, pairs).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")))
    same = lambda x, i: F.coalesce(x["h"] == F.get("_s", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_s", i + 1)["h"], F.lit(False))
    out = hold(out, _p=F.sort_array(F.transform(F.filter("_s", same), lambda x: x["p"])))
    fresh = F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3))).cast("bigint"))
    size = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    out = hold(
        out,
        n_words=F.size("_w").cast("bigint"),
        word_chars=F.length(F.replace(spaced(text), F.lit(" "), F.lit(""))).cast("bigint"),
        n_symbols=(F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("bigint"),
        n_dup_lines=(F.size("_r") - F.size(F.array_distinct("_r"))).cast("bigint"),
        n_repeat_words=_sum(fresh),
        _lines=F.transform("_m", lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("h"), size(x).cast("bigint").alias("n")))),
        _doc=F.xxhash64(F.array_join(F.filter("_m", lambda x: x != ""), "\n")),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_w", "_l", "_m", "_h", "_r", "_s", "_p")


def frequent_lines(counted: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(_host, _frequent): for each host, the hashes of the lines that too many of its distinct documents hold."""
    lines = F.array_distinct(F.transform(F.filter("_lines", lambda x: x.isNotNull()), lambda x: x["h"]))
    # The null line stands for the document itself, so that one aggregation counts both.
    held = counted.select(F.col("source").alias("_host"), "_doc", F.concat(lines, F.array(F.lit(None).cast("bigint"))).alias("_all"))
    held = held.select("_host", "_doc", F.explode("_all").alias("_line"))
    count = held.distinct().groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n"))
    count = count.filter((F.col("_n") > least) | F.col("_line").isNull())
    sizes = count.filter(F.col("_line").isNull()).select(F.col("_host").alias("_h"), F.col("_n").alias("_docs"))
    over = count.filter(F.col("_line").isNotNull()).join(sizes, F.col("_host").eqNullSafe(F.col("_h")))
    over = over.filter(F.col("_n") > share * F.col("_docs"))
    return over.groupBy("_host").agg(F.collect_list("_line").alias("_frequent"))


def _judged(counted: DataFrame, share: float, least: int, remain: float) -> DataFrame:
    """counted with _frequent, removed_words and kept."""
    # Written first: Spark then knows its size when it plans the join, and shuffles texts only if it is large.
    host = cut(frequent_lines(counted, share, least), "frequent")
    out = counted.join(host, counted["source"].eqNullSafe(host["_host"]), "left").drop("_host")
    gone = F.filter("_lines", lambda x: F.coalesce(F.array_contains(F.col("_frequent"), x["h"]), F.lit(False)))
    out = hold(out, removed_words=_sum(F.transform(gone, lambda x: x["n"])))
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= remain * F.col("n_words"))
    return out.withColumn("kept", kept)


def measure(docs: DataFrame, share: float = SHARE, least: int = LEAST, remain: float = REMAIN) -> DataFrame:
    """One row a document: doc_id, the counts, base_failed, kept and removed_words."""
    counted = cut(counts(docs.select("doc_id", "source", "text")).drop("text"), "quality")
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return _judged(counted, share, least, remain).select(*names, "kept", "removed_words")


def clean(docs: DataFrame, share: float = SHARE, least: int = LEAST, remain: float = REMAIN) -> DataFrame:
    """The documents that stay, with the columns of docs; frequent lines are taken out of their texts."""
    names, keep = docs.columns, ("doc_id", "source", "text")
    # Written with the texts that may stay, so that all texts are counted once.
    counted = counts(tuck(docs, *keep)).withColumn("text", F.when(~F.col("base_failed"), F.col("text")))
    counted = cut(counted.drop("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "quality")
    out = _judged(counted, share, least, remain).filter("kept")
    gone = lambda i: F.coalesce(F.array_contains(F.col("_frequent"), F.get("_lines", i)["h"]), F.lit(False))
    stays = F.filter(F.split("text", "\n"), lambda x, i: ~gone(i))
    out = out.withColumn("text", F.when(F.col("removed_words") > 0, F.array_join(stays, "\n")).otherwise(F.col("text")))
    new = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {}
    return untuck(out, names, *keep, **new)
