"""Score queries (Q of the survey) on the tagged answers."""

from pyspark.sql import functions as F

from kinespark.operators import rollup as R
from kinespark.operators import scoring as Q
from kinespark.sources.tables import table

from .parsing import TXT, answers
from .registry import query

r6 = lambda c: F.round(c, 6)


@query("Q01_ans_acc", f"WITH {TXT} SELECT id, CASE WHEN id % 11 > 0 AND id % 4 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM x")
def q01(spark, d):
    return answers(spark, d).select("id", Q.SCORES["ans_acc"](content=F.col("s"), gold=F.lit("B")).alias("score"))


@query("Q02_ans_tiou", "SELECT event_id AS id, round(CASE WHEN event_id % 3 = 0 THEN 0 ELSE (least(event_id % 20 + 6.0, 15) - greatest(event_id % 20, 5)) / (greatest(event_id % 20 + 6.0, 15) - least(event_id % 20, 5)) * CAST(least(event_id % 20 + 6.0, 15) > greatest(event_id % 20, 5) AS INTEGER) END, 6) AS score FROM events")
def q02(spark, d):
    a, e = F.col("event_id") % 20, F.col("event_id")
    s = F.concat(F.lit("<answer><t>"), a.cast("string"), F.lit("</t>s to <t>"), F.when(e % 3 == 0, "0").otherwise((a + 6).cast("string")), F.lit("</t>s</answer>"))
    # Every third interval runs backwards, or starts and ends at 0.
    return table(spark, d, "events").select(e.alias("id"), r6(Q.SCORES["ans_tiou"](content=s, start=F.lit(5.0), end=F.lit(15.0))).alias("score"))


@query("Q03_ans_viou", "SELECT event_id AS id, round(10.0 * 10 / (20 * 20 + 100 - 10 * 10), 6) AS score FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 0.0 FROM events WHERE event_id % 2 = 1")
def q03(spark, d):
    s = F.when(F.col("event_id") % 2 == 0, "<answer>[0, 0, 20, 20]</answer>").otherwise("<answer>none</answer>")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), r6(Q.SCORES["ans_viou"](content=s, box=F.array(*[F.lit(v) for v in (5.0, 5.0, 15.0, 15.0)]))).alias("score"))


@query("Q04_thk_temporal_point", "SELECT event_id AS id, round(CASE WHEN event_id % 7 = 0 THEN 0 ELSE exp(-power(least(abs(event_id % 60 + 0.5 - 10), abs(event_id % 60 + 0.5 - 40)), 2) / (2 * 4.0)) END, 6) AS score FROM events")
def q04(spark, d):
    return answers(spark, d).select("id", r6(Q.SCORES["thk_temporal_point"](content=F.col("s"), times=F.array(F.lit(10.0), F.lit(40.0)), progress=F.lit(0.5))).alias("score"))


@query("Q05_thk_temporal_segment", "SELECT event_id AS id, CASE WHEN event_id % 7 > 0 AND event_id % 60 + 0.5 BETWEEN 10 AND 40 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM events")
def q05(spark, d):
    return answers(spark, d).select("id", Q.SCORES["thk_temporal_segment"](content=F.col("s"), start=F.lit(10.0), end=F.lit(40.0)).alias("score"))


@query("Q06_thk_spatial", "WITH b AS (SELECT event_id AS id, floor(value) AS x, event_id % 5 > 0 AND event_id % 7 > 0 AS ok FROM events), i AS (SELECT id, ok, x, greatest(0, least(90, 95) - greatest(x, 0)) * greatest(0, least(95, 90) - 2) AS w FROM b) SELECT id, round(CASE WHEN ok AND (90 - x) * 93 + 95 * 90 - w > 0 THEN w / ((90 - x) * 93 + 95 * 90 - w) ELSE 0 END, 6) AS score FROM i")
def q06(spark, d):
    gold = F.array(F.array(*[F.lit(v) for v in (0.0, 0.0, 95.0, 90.0)]))
    return answers(spark, d).select("id", r6(Q.SCORES["thk_spatial"](content=F.col("s"), boxes=gold)).alias("score"))


@query("Q07_motion_words", "SELECT event_id AS id, CASE WHEN event_id % 4 = 3 THEN 0.5 ELSE 0 END + 0.25::DOUBLE AS score FROM events")
def q07(spark, d):
    text = F.regexp_extract("s", "<motion>(.*?)</motion>", 1)
    return answers(spark, d).select("id", Q.SCORES["motion_words"](content=text, word=F.lit("up-left"), speed_ratio=F.lit(0.5)).alias("score"))


@query("Q08_motion_tag", "SELECT event_id AS id, round(0.4 * CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0.5 ELSE 0 END + 0.3 * CASE event_id % 3 WHEN 0 THEN 1 ELSE 0 END + 0.3 * CASE event_id % 2 WHEN 0 THEN 0.5 ELSE 1 END, 6) AS score FROM events")
def q08(spark, d):
    return answers(spark, d).select("id", r6(Q.SCORES["motion_tag"](content=F.col("s"), dir=F.lit("E"), speed=F.lit("slow"), scale=F.lit("approaching"))).alias("score"))


@query("Q09_motion_grounding", "SELECT event_id AS id, 0.5 * CAST(event_id % 4 <> 0 AS INTEGER) + 0.3 * CAST(event_id % 3 <> 0 AS INTEGER) + 0.2 AS score FROM events")
def q09(spark, d):
    e, lit = F.col("event_id"), F.lit
    s = Q.SCORES["motion_grounding"](dir=lit("E"), speed=lit("slow"), scale=lit("stable"), masked_dir=F.when(e % 4 == 0, "E").otherwise("N"), masked_speed=F.when(e % 3 == 0, "slow").otherwise("fast"), masked_scale=lit(None).cast("string"))
    return table(spark, d, "events").select(e.alias("id"), s.alias("score"))


@query("Q10_format", "SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN 0.0 WHEN event_id % 3 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS score FROM events")
def q10(spark, d):
    task = F.when(F.col("id") % 3 == 0, "temporal QA").when(F.col("id") % 3 == 1, "temporal-spatial free-form QA").otherwise("visual QA")
    return answers(spark, d).select("id", Q.SCORES["format"](content=F.col("s"), task=task).alias("score"))


@query("Q14_A07_scored_advantage", f"WITH {TXT}, s AS (SELECT x.id, e.user_id AS g, CASE WHEN x.id % 11 > 0 AND x.id % 4 = 1 THEN 1.0 ELSE 0.0 END + 0.5 * CASE WHEN x.id % 7 > 0 AND x.id % 60 + 0.5 BETWEEN 10 AND 40 THEN 1.0 ELSE 0.0 END AS r FROM x JOIN events e ON e.event_id = x.id) SELECT id, round(r, 6) AS total, round((r - avg(r) OVER w) / (stddev_samp(r) OVER w + 1e-4), 5) AS advantage FROM s WINDOW w AS (PARTITION BY g)")
def q14(spark, d):
    Q.SCORES.setdefault("half_segment", Q.weighted("thk_temporal_segment", 0.5))
    df = Q.with_scores(answers(spark, d), ["ans_acc", "half_segment"], content=F.col("s"), gold=F.lit("B"), start=F.lit(10.0), end=F.lit(40.0))
    return R.advantages(df, ["user_id"], "r_total").select("id", r6(F.col("r_total")).alias("total"), F.round("advantage", 5).alias("advantage"))
