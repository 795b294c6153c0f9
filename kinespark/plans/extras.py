"""Further parsers, prompts and summaries (R16, R24, R27, T18, P26, X01 to X03 of the survey)."""

from pyspark.sql import functions as F

from kinespark.functions import geometry as G
from kinespark.functions import parse as P
from kinespark.operators import ordering
from kinespark.sources.tables import OBS, observations, table

from .parsing import answers
from .registry import query


@query("R16_claims_with_motion", "SELECT event_id AS id, 'User ' || user_id || '!' AS name, round(event_id % 60 + 0.5, 2) AS t FROM events WHERE event_id % 5 > 0 AND event_id % 7 > 0 AND floor(value) <= 90")
def r16(spark, d):
    df = answers(spark, d).select("id", F.explode(P.claims(F.col("s"))).alias("c"))
    fits = F.forall("c.boxes", lambda b: (F.get(b, F.lit(2)) >= F.get(b, F.lit(0))) & (F.get(b, F.lit(3)) >= F.get(b, F.lit(1))))
    return df.filter(fits).select("id", "c.name", F.round("c.t", 2).alias("t"))


@query("R24_normal_answer", "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN printf('%.2f', floor(value) + 1000.25) WHEN 1 THEN ' a|a ' ELSE 'two words' END AS answer FROM events")
def r24(spark, d):
    e = F.col("event_id")
    s = F.when(e % 3 == 0, F.concat(F.format_number(F.floor("value") + 1000, 0), F.lit(".25"))).when(e % 3 == 1, " A ").otherwise("Two Words")
    plain = F.trim(s)
    number = F.when(plain.rlike("^[+-]?[0-9,]*\\.?[0-9]+$"), F.replace(plain, F.lit(","), F.lit("")).try_cast("double"))
    low = F.lower(plain)
    text = F.when(F.length(low) == 1, F.concat(F.lit(" "), low, F.lit("|"), low, F.lit(" "))).otherwise(low)
    return table(spark, d, "events").select(e.alias("id"), F.when(number.isNotNull(), F.format_string("%.2f", number)).otherwise(text).alias("answer"))


@query("T18_motion_sentence", "WITH v AS (SELECT event_id AS id, (value - 50) / 1000 AS x, (event_id % 60 - 30) / 1000.0 AS y, value FROM events) SELECT id, CASE WHEN sqrt(x*x + y*y) < 0.01 THEN 'stationary (no significant motion)' ELSE (CASE WHEN abs(x) > 0.02 AND abs(y) > 0.02 THEN (CASE WHEN y < 0 THEN 'up' ELSE 'down' END) || '-' || (CASE WHEN x < 0 THEN 'left' ELSE 'right' END) WHEN abs(x) > abs(y) THEN CASE WHEN x < 0 THEN 'leftward' ELSE 'rightward' END ELSE CASE WHEN y < 0 THEN 'upward' ELSE 'downward' END END) || printf(' motion (speed: %.3f units/s, ', value / 7.3) || CASE WHEN value / 100 > 0.9 THEN 'smooth' WHEN value / 100 > 0.7 THEN 'jerky' ELSE 'erratic' END || ')' END AS s FROM v")
def t18(spark, d):
    x, y, score = (F.col("value") - 50) / 1000, (F.col("event_id") % 60 - 30) / 1000.0, F.col("value") / 100
    word = F.when(score > 0.9, "smooth").when(score > 0.7, "jerky").otherwise("erratic")
    way = G.text_direction(x, y)
    s = F.when(way == "stationary", "stationary (no significant motion)").otherwise(F.concat(way, F.format_string(" motion (speed: %.3f units/s, ", F.col("value") / 7.3), word, F.lit(")")))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), s.alias("s"))


@query("X01_track_summary", f"WITH {OBS}, f AS (SELECT obj, last(x ORDER BY t, ord) - first(x ORDER BY t, ord) AS dx, last(y ORDER BY t, ord) - first(y ORDER BY t, ord) AS dy FROM obs GROUP BY obj) SELECT obj, CASE WHEN abs(dx) >= abs(dy) THEN 'horizontal' ELSE 'vertical' END AS axis, round(sqrt(dx * dx + dy * dy), 5) AS net FROM f")
def x01(spark, d):
    order = F.struct("t", "ord")
    f = observations(spark, d).groupBy("obj").agg(*[(F.max_by(c, order) - F.min_by(c, order)).alias(f"d{c}") for c in "xy"])
    return f.select("obj", F.when(F.abs("dx") >= F.abs("dy"), "horizontal").otherwise("vertical").alias("axis"), F.round(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), 5).alias("net"))


@query("X02_track_path", f"WITH {OBS}, p AS (SELECT *, (row_number() OVER (PARTITION BY obj, kind ORDER BY t, ord) - 1) // 32 AS piece FROM obs) SELECT obj, kind, piece, string_agg(CAST(CAST(floor(x) AS INTEGER) AS VARCHAR), '→' ORDER BY t, ord) AS path FROM p GROUP BY obj, kind, piece")
def x02(spark, d):
    held = ordering.pieces(observations(spark, d), ["obj", "kind"], [F.col("t"), F.col("ord")], 32)
    df = held.groupBy("obj", "kind", "piece").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("s"))
    return df.select("obj", "kind", "piece", F.array_join(F.transform("s", lambda p: F.floor(p["x"]).cast("int").cast("string")), "→").alias("path"))


@query("X03_task_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def x03(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


