"""Evidence chains in model output as column expressions: steps with times, boxes, motion and description, and the answer.

Two forms are read. A chain has `Step N:` headers, or numbered lines where no header stands; a think-predict chain has
headers with one time and boxes in thousandths, as first thought and as then predicted.

Defined results: white space is ASCII's; a null text is an empty one; a text without any header or number is one step of
its own; a step without a time lasts from 0 to 1; one without a description has its first line of more than ten characters
that is neither a motion line nor begins with a bracket, else its first 200 characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parse import bound, boxes, interval

#: What the forms look like; fixed values.
HEADER = "(?i)Step \\d+:"
NUMBERED = "\\n(?=[^\\S\\n]*\\d+\\.[^\\S\\n]+\\S)"
ANSWER = "(?i)answer[:\\s]+"
NAMED_ANSWER = "(?isd)(?:final\\s+)?answer[:\\s]+(.+?)(?:\\n|$)"
MOTION = "(?isd)Motion[:\\s]+(.+?)(?:\\n|Description:|$)"
DESCRIPTION = "(?isd)Description[:\\s]+(.+?)(?:\\n\\n|Step \\d+:|$)"
TIMED_HEADER = "(?i)Step\\s+(\\d+):\\s*\\[([^\\]]+)\\]\\s*([^\\n]+)"
SHORT, WHOLE, SENTENCE_END = 10, 200, "[.!?]\\s+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def _group(text: Column, pattern: str) -> Column:
    """The first group of a pattern, stripped; '' without a match."""
    return strip(F.regexp_extract(text, pattern, 1))


def _tail(parts: Column) -> Column:
    return F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts)))


def step(text: Column) -> Column:
    """struct<start, end, boxes, motion, description> of one step's text."""
    lines = F.transform(F.split(text, "\n"), strip)
    line = F.get(F.filter(lines, lambda x: ~x.startswith("Motion:") & ~x.startswith("[") & (F.length(x) > SHORT)), 0)
    # Patterns run only where their word stands, and what is named more than once is bound, else they run again.
    low = F.lower(text)
    described = F.when(low.contains("description"), F.regexp_extract(text, DESCRIPTION, 1)).otherwise("")
    said = bound(described, lambda d: F.when(d != "", strip(d)).otherwise(line))
    time = F.coalesce(interval(text), F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("end")))
    motion = F.when(low.contains("motion"), _group(text, MOTION)).otherwise("")
    description = bound(said, lambda d: F.when(d != "", d).otherwise(F.substring(text, 1, WHOLE)))
    made = lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), boxes(text).cast("array<array<double>>").alias("boxes"), motion.alias("motion"), description.alias("description"))
    return bound(time, made)


def _cut(text: Column) -> Column:
    """struct<body, answer>: a step's text up to its answer, and the answer after it; null if it names none."""
    parts = F.when(F.lower(text).contains("answer:"), F.split(text, ANSWER, 2))
    return bound(parts, lambda p: F.struct(F.coalesce(F.get(p, 0), text).alias("body"), strip(F.get(p, 1)).alias("answer")))


def _parts(text: Column) -> Column:
    """array<struct<body, answer>> of the steps' texts; an answer is looked for in every headed step, or the last numbered one."""
    plain = lambda x: F.struct(x.alias("body"), F.lit(None).cast("string").alias("answer"))
    numbered = lambda lines: F.transform(lines, lambda x, k: F.when(k == F.size(lines) - 1, _cut(x)).otherwise(plain(x)))
    return bound(F.split(text, HEADER), lambda parts: F.when(F.size(parts) > 1, F.transform(_tail(parts), _cut)).otherwise(bound(F.split(text, NUMBERED), numbered)))


def named_answer(text: Column) -> Column:
    """What follows `answer` to the end of its line, without final marks; '' if nothing does."""
    found = strip(F.regexp_replace(_group(text, NAMED_ANSWER), "[.!?]+$", ""))
    return F.when(F.lower(text).contains("answer"), found).when(text.isNotNull(), "")


def _answer(parts: Column, whole: Column) -> Column:
    answers = F.filter(F.transform(parts, lambda p: p["answer"]), lambda a: a.isNotNull())
    return bound(F.try_element_at(answers, F.lit(-1)), lambda last: F.when(last != "", last).otherwise(named_answer(whole)))


def chain_steps(text: Column) -> Column:
    """The steps of `chain`, without its answer."""
    return F.transform(_parts(F.coalesce(text, F.lit(""))), lambda p: step(p["body"]))


def chain_answer(text: Column) -> Column:
    """The answer of `chain`, without reading its steps."""
    return bound(F.coalesce(text, F.lit("")), lambda whole: _answer(_parts(whole), whole))


def chain(text: Column) -> Column:
    """struct<steps, answer>: the last answer that a step names, else the text's."""

    def made(whole: Column) -> Column:
        return bound(_parts(whole), lambda parts: F.struct(F.transform(parts, lambda p: step(p["body"])).alias("steps"), _answer(parts, whole).alias("answer")))

    return bound(F.coalesce(text, F.lit("")), made)


def think_predict(text: Column) -> Column:
    """array<struct<step, time, description, think, predict, motion>>: headed steps with one time; boxes in 0 to 1."""
    def thought(body: Column, word: str) -> Column:
        pattern = f"{word}:\\s*\\((\\d+),(\\d+)\\),\\((\\d+),(\\d+)\\)"
        four = lambda m: F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda v: v.try_cast("int") / F.lit(1000.0))
        return F.when(body.contains(f"{word}:"), F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), four)).when(body.isNotNull(), F.array().cast("array<array<double>>"))

    def made(s: Column) -> Column:
        time = strip(F.replace(s["t"], F.lit("s"), F.lit(""))).try_cast("double")
        return F.struct(s["n"].try_cast("int").alias("step"), time.alias("time"), strip(s["d"]).alias("description"), thought(s["b"], "Think").alias("think"), thought(s["b"], "Predict").alias("predict"), _group(s["b"], "Motion:\\s*([^\\n]+)").alias("motion"))

    def headed(whole: Column) -> Column:
        # Heads are found once, and their parts are read from each.
        heads = F.regexp_extract_all(whole, F.lit(TIMED_HEADER), F.lit(0))
        part = lambda h, k: F.regexp_extract(h, TIMED_HEADER, k)
        return F.zip_with(heads, _tail(F.split(whole, TIMED_HEADER)), lambda h, b: made(F.struct(part(h, 1).alias("n"), part(h, 2).alias("t"), part(h, 3).alias("d"), b.alias("b"))))

    return bound(F.coalesce(text, F.lit("")), headed)


def steps(text: Column) -> Column:
    """The steps of `chain`'s form: a think-predict chain's, each a second long, where one of them has boxes, else a chain's."""

    def timed(s: Column) -> Column:
        start = F.coalesce(s["time"], F.lit(0.0))
        found = F.when(F.size(s["predict"]) > 0, s["predict"]).otherwise(s["think"])
        return F.struct(start.alias("start"), (start + 1).alias("end"), found.alias("boxes"), s["motion"].alias("motion"), s["description"].alias("description"))

    thought = F.filter(F.transform(think_predict(text), timed), lambda s: F.size(s["boxes"]) > 0)
    # Boxes stand behind one of these words only.
    thought = F.when(text.contains("Think:") | text.contains("Predict:"), thought)
    return bound(thought, lambda t: F.when(F.size(t) > 0, t).otherwise(chain_steps(text)))


def final_answer(text: Column) -> Column:
    """The answer of a chain; else the text's last sentence; '' for an empty text."""
    last = strip(F.element_at(F.split(text, SENTENCE_END), -1))
    found = bound(chain_answer(text), lambda a: F.when(a != "", a).otherwise(last))
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(found)


def valid(found: Column, width: int = 1920, height: int = 1080) -> Column:
    """Whether there are steps, none ends before it starts, and all boxes have sides and lie within twice the image."""
    at = lambda b, k: F.get(b, F.lit(k))
    fits = lambda b: (F.size(b) == 4) & ~F.exists(b, lambda v: v.isNull() | (v < 0)) & (at(b, 0) < at(b, 2)) & (at(b, 1) < at(b, 3)) & (at(b, 2) <= 2 * width) & (at(b, 3) <= 2 * height)
    return F.coalesce((F.size(found) > 0) & F.forall(found, lambda s: (s["start"] <= s["end"]) & F.forall(s["boxes"], lambda b: F.coalesce(fits(b), F.lit(False)))), F.lit(False))


def early(found: Column, tolerance: float = 0.1) -> Column:
    """array<int>: the steps (from 1) that start before the step before them ends, by more than the tolerance."""
    state = F.struct(F.lit(0.0).alias("end"), F.array().cast("array<int>").alias("held"), F.lit(0).alias("n"))

    def after(a: Column, s: Column) -> Column:
        held = F.when(s["start"] < a["end"] - tolerance, F.concat(a["held"], F.array(a["n"] + 1))).otherwise(a["held"])
        return F.struct(s["end"].alias("end"), held.alias("held"), (a["n"] + 1).alias("n"))

    return F.aggregate(found, state, after, lambda a: a["held"])
