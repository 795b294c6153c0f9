"""Evidence chains and composite scores over texts of five forms (R11 to R15, R30, W16, Q11, Q12 of the survey).

Each order's lines are written as the steps of one text: headed, without times, as numbered lines, as think-predict steps,
and malformed. The SQL states from the numbers, form by form, what is to be read back."""

from pyspark.sql import functions as F

from kinespark.functions import evidence as E
from kinespark.operators.evidence import composite
from kinespark.sources.tables import table

from .registry import query

FORMS = 5
LINES = """l AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS INTEGER) AS q, CAST(round(l_discount * 100) AS INTEGER) AS x, CAST(round(l_tax * 100) AS INTEGER) AS y, l_orderkey % 5 AS f,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem),
s AS (SELECT *, CASE f WHEN 2 THEN printf('%d. from %ds to %ds <box>%d,%d,%d,%d</box>', n, n, n + 2, x, y, x + q, y + 5 * n) WHEN 4 THEN printf(' [%d-%d <bbox>[%d,%d,oops]</bbox> line %d of %d moves', n, n + 2, x, y, n, k) || CASE WHEN i < m THEN chr(10) ELSE '' END ELSE printf('line %d of %d moves', n, k) END AS said FROM l)"""


def _texts(spark, d):
    """k, f, text and gold of each order."""
    c = F.col
    x, y, q, n, k = F.round(c("l_discount") * 100).cast("int"), F.round(c("l_tax") * 100).cast("int"), c("l_quantity").cast("int"), c("l_linenumber"), c("l_orderkey")
    df = table(spark, d, "lineitem").select(k.alias("k"), n.alias("n"), F.struct(n, "l_partkey", "l_extendedprice").alias("place"), x.alias("x"), y.alias("y"), (x + q).alias("u"), (y + 5 * n).alias("v"))
    said = F.format_string("line %d of %d moves", c("n"), c("k"))
    box = lambda form, by=0: F.format_string(form, c("x") + by, c("y") + 2 * by, c("u") + by, c("v") + 2 * by)
    forms = [
        F.concat(F.format_string("Step %d: [%d.0s–%ds] ", c("n"), c("n"), c("n") + 2), box("<bbox>[%d,%d,%d,%d]</bbox> "), box("<bbox>[%d, %d, %d, %d]</bbox>", 1), F.format_string("\nMotion: it moves %d\nDescription: ", c("n")), said, F.lit("\n\n")),
        F.concat(F.format_string("STEP %d:\nDescription: ", c("n")), said, F.lit("\n\n")),
        F.concat(F.format_string("%d. from %ds to %ds ", c("n"), c("n"), c("n") + 2), box("<box>%d,%d,%d,%d</box>"), F.lit("\n")),
        F.concat(F.format_string("Step %d: [%d.0s] ", c("n"), c("n")), said, F.format_string("\nThink: (%d,%d),(9,9)\nPredict: ", c("n"), c("n") + 3), box("(%d,%d),(%d,%d)\nPredict: "), box("(%d,%d),(%d,%d)\n", 1), F.format_string("Motion: it moves %d\n", c("n"))),
        F.concat(F.format_string("Step %d: [%d-%d <bbox>[%d,%d,oops]</bbox> ", c("n"), c("n"), c("n") + 2, c("x"), c("y")), said, F.lit("\n")),
    ]
    form = c("k") % FORMS
    part = F.coalesce(*[F.when(form == i, t) for i, t in enumerate(forms)])
    scale = F.when(form == 3, 1000.0).otherwise(1.0)
    gold = F.struct((c("n") + 0.5).alias("t_s"), (c("n") + 2.0).alias("t_e"), F.array(*[(c(p) + 1) / scale for p in "xyuv"]).alias("bbox"), F.array(F.array(F.lit(1.0), F.lit(2.0))).alias("displacements"), F.format_string("line %d moves", c("n")).alias("caption"))
    df = df.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("place", part.alias("part"), gold.alias("gold")))).alias("s"))  # an order has few lines
    text = F.array_join(F.transform("s", lambda s: s["part"]), "")
    text = F.when(form == 0, F.concat(F.lit("intro "), text, F.format_string("Answer: order %d!", c("k")))).when(form == 2, F.concat(text, F.format_string("answer: order %d", c("k")))).otherwise(F.regexp_replace(text, "\n$", ""))
    return df.select("k", form.alias("f"), text.alias("text"), F.transform("s", lambda s: s["gold"]).alias("gold"))


@query("R11_R12_evidence_steps", f"WITH {LINES} SELECT k, CAST(i AS INTEGER) AS step, CASE f WHEN 0 THEN n WHEN 2 THEN n WHEN 3 THEN n ELSE 0 END::DOUBLE AS start, CASE f WHEN 0 THEN n + 2 WHEN 2 THEN n + 2 WHEN 3 THEN n + 3 ELSE 1 END::DOUBLE AS stop, CASE f WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS n_boxes, CASE WHEN f IN (0, 2) THEN x + q END AS right_side, CASE WHEN f IN (0, 3) THEN 'it moves ' || n ELSE '' END AS motion, CASE f WHEN 3 THEN printf('Think: (%d,%d),(9,9)', n, n + 3) ELSE said END AS description, CASE f WHEN 0 THEN 'order ' || k || '!' WHEN 2 THEN 'order ' || k ELSE '' END AS answer FROM s")
def r12(spark, d):
    df = _texts(spark, d).select("k", F.inline(F.array(E.chain(F.col("text")))))
    df = df.select("k", "answer", F.posexplode("steps").alias("i", "s"))
    right = F.get(F.get(F.col("s.boxes"), 0), 2).cast("int")
    return df.select("k", (F.col("i") + 1).alias("step"), "s.start", F.col("s.end").alias("stop"), F.size("s.boxes").alias("n_boxes"), right.alias("right_side"), "s.motion", "s.description", "answer")


@query("R13_think_predict", f"WITH {LINES} SELECT k, n AS step, CASE f WHEN 3 THEN n END::DOUBLE AS time, CASE f WHEN 0 THEN printf('<bbox>[%d,%d,%d,%d]</bbox> <bbox>[%d, %d, %d, %d]</bbox>', x, y, x + q, y + 5 * n, x + 1, y + 2, x + q + 1, y + 5 * n + 2) WHEN 4 THEN printf('</bbox> line %d of %d moves', n, k) ELSE said END AS description, CASE f WHEN 3 THEN x / 1000.0 END AS x1, CASE f WHEN 3 THEN (y + 2) / 1000.0 END AS y1, CASE f WHEN 3 THEN n / 1000.0 END AS thought, CASE f WHEN 4 THEN '' ELSE 'it moves ' || n END AS motion FROM s WHERE f IN (0, 3, 4)")
def r13(spark, d):
    df = _texts(spark, d).select("k", F.explode(E.think_predict(F.col("text"))).alias("s"))
    at = lambda c, i, k: F.get(F.get(F.col(c), i), k)
    return df.select("k", "s.step", "s.time", "s.description", at("s.predict", 0, 0).alias("x1"), at("s.predict", 1, 1).alias("y1"), at("s.think", 0, 0).alias("thought"), "s.motion")


@query("R14_R30_final_answer", f"WITH {LINES} SELECT k, max(CASE f WHEN 0 THEN 'order ' || k || '!' WHEN 2 THEN 'order ' || k WHEN 1 THEN printf('line %d of %d moves', n, k) WHEN 4 THEN printf('[%d-%d <bbox>[%d,%d,oops]</bbox> line %d of %d moves', n, n + 2, x, y, n, k) ELSE 'it moves ' || n END) AS answer FROM s WHERE i = m GROUP BY k")
def r14(spark, d):
    # Without an answer it is the last sentence; these texts have no sentences but their last lines.
    answer = F.col("answer")
    ends = F.regexp_extract(answer, "(line \\d+ of \\d+ moves)$", 1)
    last = F.when(F.col("f") == 1, ends).when(F.col("f") == 3, F.regexp_extract(answer, "(it moves \\d+)$", 1)).when(F.col("f") == 4, F.regexp_extract(answer, "(\\[\\d+-\\d+ <bbox>[^<]*</bbox> line \\d+ of \\d+ moves)$", 1))
    # A generator keeps the answer; a projection would read it again for each of these.
    df = _texts(spark, d).select("k", "f", F.inline(F.array(F.struct(E.final_answer(F.col("text")).alias("answer")))))
    return df.select("k", F.coalesce(last, answer).alias("answer"))


@query("R15_W16_format_valid", f"WITH {LINES}, b AS (SELECT *, lag(n) OVER (PARTITION BY k ORDER BY i) AS before FROM s) SELECT k, bool_and(CASE WHEN f IN (0, 2) THEN q > 0 ELSE TRUE END) AS valid, count(*) FILTER (CASE f WHEN 0 THEN n < before + 1.9 WHEN 2 THEN n < before + 1.9 WHEN 3 THEN n < before + 2.9 ELSE i > 1 END) AS early FROM b GROUP BY k")
def r15(spark, d):
    df = _texts(spark, d).select("k", F.inline(F.array(F.struct(E.chain_steps(F.col("text")).alias("steps")))))
    return df.select("k", E.valid(F.col("steps")).alias("valid"), F.size(E.early(F.col("steps"))).cast("bigint").alias("early"))


WORDS = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({}), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: w <> ''))"


@query("Q11_Q12_composite", f"""WITH {LINES}, g AS (SELECT *, printf('line %d moves', n) AS gold, CASE WHEN f IN (0, 2, 3) THEN greatest(q - 1, 0) * (5.0 * n - 1) END AS inter FROM s),
w AS (SELECT *, {WORDS.format("said")} AS a, {WORDS.format("gold")} AS b FROM g),
c AS (SELECT k, max(f) AS f, coalesce(avg(inter / (10.0 * q * n - inter)), 0) AS spatial, avg(CASE f WHEN 0 THEN .75 WHEN 2 THEN .75 WHEN 3 THEN .25 ELSE 0 END)::DOUBLE AS temporal, avg(CASE f WHEN 0 THEN 1 WHEN 3 THEN .6004 ELSE 0 END)::DOUBLE AS motion,
  avg(.6 * 2 * len(list_intersect(a, b)) / (len(a) + len(b)) + .4 * (1 - levenshtein(said, gold) / greatest(length(said), length(gold))::DOUBLE)) AS caption FROM w GROUP BY k)
SELECT k, round(spatial, 6) AS spatial, round(temporal, 6) AS temporal, round(motion, 6) AS motion, round(caption, 6) AS caption, round(least(1, .25 * spatial + .15 * temporal + .35 * motion + .2 * caption), 6) AS score FROM c""")
def q11(spark, d):
    df = composite(_texts(spark, d).select("k", "text", "gold"), "text", "gold")
    return df.select("k", *[F.round(c, 6).alias(c) for c in ("spatial", "temporal", "motion", "caption", "score")])
