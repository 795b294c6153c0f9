"""Secret scans: fixed patterns and a battery of randomness tests (DataFrame functions only).

Base kinds: `assign`, `access` and `hex`. The method adds the kind `random`: tokens of 20 or more characters, and the
parts of such tokens between `_` and `-`, whose encoding (hex, base32, base36, base64 or base64url) is inferred from
their characters. Three statistics are taken of each: chi-squared uniformity over the alphabet, Wald-Wolfowitz runs about
its middle, and the lag-1 serial correlation. The null hypothesis is a structured text of the same length and alphabet,
in which each statistic is shifted by an amount that grows with the length (ALPHABETS has the shifts, measured on
identifiers made of English words and on the hex form of English text). The standardised distances below these nulls are
added with the weights of BATTERY to one normal deviate and its probability p: a token is found random only if all three
together are too near to randomness for structured text. Over all tokens tested in the corpus the p are held to a
false-discovery rate by Benjamini and Hochberg's step-up rule, weighted by length (longer tokens have more power; the
weights have mean 1). What the pooled share of tokens without structure is beyond English isn't known; a Markov source
with less structure than English words is taken for random too often.

Positions come from the gaps: splitting by a pattern and extracting it give alternating pieces, whose lengths are
summed in order for each text and kind.

Defined results: a null or empty text has no span; a null doc_id is an id like others; repeated rows are scanned once
and each get the result; overlapping base spans of different kinds all stay; random spans that overlap a base span are
dropped, and parts found in a token that is found whole; tokens with equal p are found together or not at all (ties);
very long texts are scanned whole; an empty table gives an empty result; columns beyond doc_id and text, of whatever
names, pass through `redact`.

Scale: the text is scanned in place; only texts' match lengths and tested tokens are shuffled, by a 128-bit key of the
row. The step-up rule needs a histogram of the p (at most 6,400 bins), not their order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hold, row_key, tuck, untuck

KINDS = ("assign", "access", "hex", "random")
#: The patterns of the kinds; fixed values.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
TOKEN = "[A-Za-z0-9+/_-]{20,}={0,2}"
PART = "(?<=[_-])[A-Za-z0-9+/]{20,}|(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20,}+(?=[_-])"
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Ahead of a token that has a digit; it starts where a token does, so that long runs cost linear time.
DIGIT = "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])"
#: Alphabets by encoding, and the shifts of structured text in them: chi-squared a character, and the deviates of runs and
#: of serial correlation for each root of the length.
ALPHABETS = {
    "hex": (_DIGITS + "abcdef", 1.1, 0.18, 0.12),
    "HEX": (_DIGITS + "ABCDEF", 1.1, 0.18, 0.12),
    "base32": (_UPPER + "234567", 0.9, 0.13, 0.17),
    "base36": (_LOWER + _DIGITS, 0.9, 0.13, 0.17),
    "BASE36": (_UPPER + _DIGITS, 0.9, 0.13, 0.17),
    "base64": (_UPPER + _LOWER + _DIGITS + "+/", 1.5, 0.14, 0.11),
    "base64url": (_UPPER + _LOWER + _DIGITS + "-_", 1.5, 0.14, 0.11),
}
RATE, LONG, BATTERY = 0.01, 64, (2.0, 1.0, 1.0)
BINS = 20  # a decade


def _matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    held = whole if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(whole.alias("w"), F.slice(gaps, 1, F.greatest(F.lit(0), F.size(gaps) - 1)).alias("g"), held.alias("h"))
    made = F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["g"]).cast("bigint").alias("gap"), F.length(x["w"]).cast("bigint").alias("len"), (F.length(x["h"]) >= least).alias("ok"), F.when(F.lit(kind >= 3), x["w"]).alias("token")))
    return F.when(text.rlike(pattern), made)


def spans(docs: DataFrame) -> DataFrame:
    """(_key, kind, start, end, token): all base spans and all tokens (3) and their parts (4) to be tested, of each distinct
    (doc_id, text)."""
    text = docs.filter(F.col("text").rlike(f"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]|{HEX}|{DIGIT}{TOKEN}"))
    found = text.select(row_key("doc_id", "text").alias("_key"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("t")))).alias("_x")).select("_key", F.col("_x.t").alias("_t"))
    kinds = [_matches(F.col("_t"), ASSIGN, 0, 2, 12), _matches(F.col("_t"), ACCESS, 1), _matches(F.col("_t"), HEX, 2), _matches(F.col("_t"), TOKEN, 3), _matches(F.col("_t"), PART, 4)]
    rows = hold(found, _a=kinds[0], _b=kinds[1], _c=kinds[2], _d=kinds[3], _e=kinds[4]).drop("_t")
    rows = rows.select("_key", F.explode(F.flatten(F.array_compact(F.array("_a", "_b", "_c", "_d", "_e")))).alias("m")).select("_key", "m.*")
    rows = rows.repartition("_key").groupBy("_key", "kind", "i").agg(*[F.first(c).alias(c) for c in ("gap", "len", "ok", "token")])
    upto = Window.partitionBy("_key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).filter("ok")
    return rows.select("_key", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "token")


def _normal_tail(z: Column) -> Column:
    """P(Z <= z), from above for z below -1.5 (Mills' ratio)."""
    far = F.exp(-z * z / 2) / (2.5066282746310002 * F.abs(z))
    return F.when(z < -1.5, F.greatest(far, F.lit(1e-300))).otherwise(1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z)))


def tested(tokens: DataFrame) -> DataFrame:
    """The tokens of an inferred encoding with p and weight."""
    t = F.regexp_replace("token", "=+$", "")
    digit, lower, upper = t.rlike("[0-9]"), t.rlike("[a-z]"), t.rlike("[A-Z]")
    kind = F.when(t.rlike("^[0-9a-f]+$") & digit & lower, "hex").when(t.rlike("^[0-9A-F]+$") & digit & upper, "HEX")
    kind = kind.when(t.rlike("^[A-Z2-7]+$") & digit & upper, "base32").when(t.rlike("^[A-Z0-9]+$") & digit & upper, "BASE36")
    kind = kind.when(t.rlike("^[a-z0-9]+$") & digit & lower, "base36").when(digit & lower & upper & ~t.rlike("[_-]"), "base64")
    kind = kind.when(digit & lower & upper & ~t.rlike("[+/]"), "base64url")
    df = hold(tokens, _t=t, _kind=kind).filter(F.col("_kind").isNotNull())
    pick = lambda f: F.coalesce(*[F.when(F.col("_kind") == k, f(k)) for k in ALPHABETS])
    df = hold(df, _abc=pick(lambda k: F.lit(ALPHABETS[k][0])), _shifts=pick(lambda k: F.array(*[F.lit(x) for x in ALPHABETS[k][1:]])), _c=F.split("_t", ""))
    df = hold(df, _x=F.transform("_c", lambda c: F.instr(F.col("_abc"), c)), _n=F.length("_t").cast("double"), _m=F.length("_abc").cast("double"))
    number = lambda f, a: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x).cast("double"))
    letters = F.transform(F.split("_abc", ""), lambda c: F.col("_n") - F.length(F.replace(F.col("_t"), c, F.lit(""))))
    high = lambda x: (2 * x > F.col("_m")).cast("int")
    later = F.slice("_x", 2, F.size("_x"))
    both = F.zip_with(F.slice("_x", 1, F.size("_x") - 1), later, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    df = hold(df, _squares=number(lambda n: n * n, letters), _high=number(high, F.col("_x")), _both=both, _mean=number(lambda x: x, F.col("_x")) / F.col("_n"))
    df = hold(
        df,
        _runs=1 + number(lambda p: high(p["a"]) != high(p["b"]), F.col("_both")),
        _var=number(lambda x: (x - F.col("_mean")) * (x - F.col("_mean")), F.col("_x")),
        _cov=number(lambda p: (p["a"] - F.col("_mean")) * (p["b"] - F.col("_mean")), F.col("_both")),
    )
    n, a, b = F.col("_n"), F.col("_high"), F.col("_n") - F.col("_high")
    chi, df_, away = F.col("_squares") * F.col("_m") / n - n, F.col("_m") - 1, F.col("_shifts")[0] * F.col("_n")
    uniform = (chi - df_ - away) / F.sqrt(2 * (df_ + 2 * away))
    product = 2 * a * b
    spread = F.sqrt(F.greatest(product * (product - n) / (n * n * (n - 1)), F.lit(1e-9)))
    runs = F.abs(F.col("_runs") - product / n - 1) / spread
    serial = F.abs(F.col("_cov") / F.greatest(F.col("_var"), F.lit(1e-9)) + 1 / n) * F.sqrt(n)
    deviates = (uniform, runs - F.col("_shifts")[1] * F.sqrt(n), serial - F.col("_shifts")[2] * F.sqrt(n))
    z = sum((w * x for w, x in zip(BATTERY, deviates)), F.lit(0.0)) / math.sqrt(sum(w * w for w in BATTERY))
    return df.select(*tokens.columns, _normal_tail(z).alias("p"), F.least(n, F.lit(float(LONG))).alias("weight"))


def discoveries(tokens: DataFrame, rate: float = RATE) -> DataFrame:
    """The tokens found random; the rate of false ones among them is held to `rate` over the whole corpus."""
    held = cut(tested(tokens), "secrets")
    n, mean = held.agg(F.count(F.lit(1)), F.avg("weight")).first()
    held = held.withColumn("_bin", F.floor(-F.log10(F.least(F.col("p") * (mean or 1.0) / F.col("weight"), F.lit(1.0))) * BINS).cast("int"))
    bins = held.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
    rank = F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy(F.col("_bin").desc()))
    passed = bins.withColumn("_rank", rank).filter(F.pow(F.lit(10.0), -F.col("_bin") / BINS) <= rate * F.col("_rank") / max(n, 1))
    edge = passed.agg(F.min("_bin")).first()[0]
    return held.filter(F.lit(False) if edge is None else F.col("_bin") >= edge).select(*tokens.columns)


def all_spans(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """(_key, kind, start, end): base spans, and random ones that don't overlap them."""
    every = cut(spans(docs), "secret-spans")
    base = every.filter("kind < 3").select("_key", "kind", "start", "end")
    extra = discoveries(every.filter("kind >= 3"), rate).select("_key", "kind", "start", "end")
    # Tokens don't overlap one another, nor do parts; a part lies in one token, and that one comes before it if found.
    whole = Window.partitionBy("_key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    extra = extra.withColumn("_over", F.max(F.when(F.col("kind") == 3, F.col("end"))).over(whole))
    extra = extra.filter((F.col("kind") == 3) | ~F.coalesce(F.col("_over") >= F.col("end"), F.lit(False))).withColumn("kind", F.lit(3)).drop("_over")
    both = base.unionByName(extra)
    by = Window.partitionBy("_key").orderBy("start", "kind")
    reach = F.max(F.when(F.col("kind") < 3, F.col("end")))
    ahead = F.min(F.when(F.col("kind") < 3, F.col("start")))
    both = both.withColumns({"_reach": reach.over(by.rowsBetween(Window.unboundedPreceding, -1)), "_ahead": ahead.over(by.rowsBetween(1, Window.unboundedFollowing))})
    clash = (F.col("_reach") > F.col("start")) | (F.col("_ahead") < F.col("end"))
    return both.filter((F.col("kind") < 3) | ~F.coalesce(clash, F.lit(False))).drop("_reach", "_ahead")


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans."""
    found = all_spans(docs, rate).groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("_s"))
    out = docs.select("doc_id", row_key("doc_id", "text").alias("_key")).join(found, "_key", "left")
    out = hold(out, _all=F.coalesce("_s", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("_all", lambda s: s["kind"] == k)).cast("bigint")
    base = F.sha2(text(F.filter("_all", lambda s: s["kind"] < 3)).cast("binary"), 256)
    return out.select("doc_id", *[number(k).alias(f"n_{x}") for k, x in enumerate(KINDS)], base.alias("base_sha256"), text(F.col("_all")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", rate: float = RATE) -> DataFrame:
    """docs with each span, overlapping ones merged, replaced by `mark`."""
    names, keep = docs.columns, ("doc_id", "text")
    before = Window.partitionBy("_key").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cuts = all_spans(docs, rate).withColumn("_reach", F.coalesce(F.max("end").over(before), F.lit(0))).filter("end > _reach")
    cuts = cuts.select("_key", (F.greatest("start", "_reach")).alias("start"), "end", "_reach")
    cuts = cuts.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_s"))
    # Written first: Spark then knows its size when it plans the join, and shuffles texts only if it is large.
    cuts = cut(cuts, "secret-cuts")
    out = tuck(docs, *keep).withColumn("_key", row_key("doc_id", "text")).join(cuts, "_key", "left")
    start = lambda i: F.when(i > 0, F.get("_s", i - 1)["end"]).otherwise(F.lit(0))
    glue = lambda s, i: F.when((i > 0) & (s["start"] == start(i)), F.lit("")).otherwise(F.lit(mark))
    pieces = F.transform("_s", lambda s, i: F.concat(F.col("text").substr((start(i) + 1).cast("int"), (s["start"] - start(i)).cast("int")), glue(s, i)))
    rest = F.col("text").substr((F.element_at("_s", -1)["end"] + 1).cast("int"), F.length("text"))
    out = out.withColumn("text", F.when(F.col("_s").isNotNull(), F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("text")))
    new = {}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("_s").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row")["n_chars"])
    return untuck(out, names, *keep, **new)
