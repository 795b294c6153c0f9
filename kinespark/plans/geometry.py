"""Queries on boxes, intervals, tracks and frame arithmetic (M and W of the survey)."""

from pyspark.sql import functions as F

from kinespark.functions import geometry as G
from kinespark.operators import trajectory as T
from kinespark.sources.tables import BOX, OBS, PAIR, boxes, observations, seconds, table

from .registry import query

r6 = lambda c: F.round(c, 6)


def pairs(spark, d):
    """Each order's neighbouring lines as two boxes a and b."""
    df = boxes(spark, d)
    nxt = df.select("ok", (F.col("n") - 1).alias("n"), F.col("box").alias("b"))
    return df.withColumnRenamed("box", "a").join(nxt, ["ok", "n"])


SQL_IOU = "CASE WHEN least(ax2,bx2) - greatest(ax1,bx1) > 0 AND least(ay2,by2) - greatest(ay1,by1) > 0 THEN (least(ax2,bx2) - greatest(ax1,bx1)) * (least(ay2,by2) - greatest(ay1,by1)) / ((ax2-ax1)*(ay2-ay1) + (bx2-bx1)*(by2-by1) - (least(ax2,bx2) - greatest(ax1,bx1)) * (least(ay2,by2) - greatest(ay1,by1))) ELSE 0 END"


@query("M01_bbox_iou", f"WITH {PAIR} SELECT ok, n, round({SQL_IOU}, 6) AS iou FROM pair")
def m01(spark, d):
    return pairs(spark, d).select("ok", "n", r6(G.iou(F.col("a"), F.col("b"))).alias("iou"))


@query("M02_iou_clamped", f"WITH {PAIR} SELECT ok, n, round({SQL_IOU}, 6) AS iou FROM pair")
def m02(spark, d):
    return pairs(spark, d).select("ok", "n", r6(G.iou_clamped(F.col("a"), F.col("b"))).alias("iou"))


@query("M03_iou_struct", f"WITH {PAIR} SELECT ok, n, round({SQL_IOU}, 6) AS iou FROM pair WHERE n % 2 = 1")
def m03(spark, d):
    df = pairs(spark, d).filter("n % 2 = 1").withColumn("s", F.struct(*[G.at(F.col("a"), k).alias(x) for k, x in enumerate(("xmin", "ymin", "xmax", "ymax"))]))
    return df.select("ok", "n", r6(G.iou_clamped(F.array("s.xmin", "s.ymin", "s.xmax", "s.ymax"), F.col("b"))).alias("iou"))


@query("M04_best_iou", f"WITH {PAIR} SELECT ok, round(max({SQL_IOU}), 6) AS best FROM (SELECT a.ok, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM box a JOIN box b ON a.ok = b.ok AND a.n = 1 AND b.n > 1) GROUP BY ok")
def m04(spark, d):
    # An order has at most seven lines, so its boxes fit one row.
    df = boxes(spark, d)
    others = df.filter("n > 1").groupBy("ok").agg(F.collect_list("box").alias("bs"))
    best = df.filter("n = 1").join(others, "ok").select("ok", G.best_iou(F.col("box"), F.col("bs")).alias("best"))
    return best.groupBy("ok").agg(r6(F.max("best")).alias("best"))


AP = (0.1, 0.3, 0.5, 0.7, 0.9)


@query("M05_spatial_metrics", f"WITH {PAIR}, v AS (SELECT {SQL_IOU} AS iou FROM pair) SELECT " + ", ".join(f"round(avg(CASE WHEN iou >= {t} THEN 1.0 ELSE 0 END), 6) AS ap_{int(t * 10)}" for t in AP) + ", round(avg(iou), 6) AS mean_iou FROM v")
def m05(spark, d):
    df = pairs(spark, d).select(G.iou_clamped(F.col("a"), F.col("b")).alias("iou"))
    return df.agg(*[r6(F.avg((F.col("iou") >= t).cast("double"))).alias(f"ap_{int(t * 10)}") for t in AP], r6(F.avg("iou")).alias("mean_iou"))


WINDOWS = "w AS (SELECT l_orderkey AS ok, epoch_us(min(l_shipdate)) / 1000000.0 AS a, epoch_us(max(l_shipdate)) / 1000000.0 AS b FROM lineitem GROUP BY l_orderkey), o AS (SELECT o_orderkey AS ok, epoch_us(o_orderdate) / 1000000.0 AS s FROM orders)"


def windows(spark, d):
    w = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ok")).agg(F.min(seconds("l_shipdate")).alias("a"), F.max(seconds("l_shipdate")).alias("b"))
    return w.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("ok"), seconds("o_orderdate").alias("s")), "ok")


@query("M06_interval_iou", f"WITH {WINDOWS} SELECT ok, round(CASE WHEN least(b, s + 5184000) - greatest(a, s) > 0 THEN (least(b, s + 5184000) - greatest(a, s)) / (greatest(b, s + 5184000) - least(a, s)) ELSE 0 END, 6) AS tiou FROM w JOIN o USING (ok)")
def m06(spark, d):
    c = F.col
    return windows(spark, d).select("ok", r6(G.interval_iou(c("a"), c("b"), c("s"), c("s") + 5184000)).alias("tiou"))


@query("M07_proximity", "SELECT l_orderkey AS ok, l_linenumber AS n, round(exp(-power(l_quantity / 10, 2) / (2 * power(CASE WHEN l_discount * 10 < 0.75 THEN 4 * (1 - l_discount * 10) ELSE 1 END, 2))), 6) AS near FROM lineitem")
def m07(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("n"), r6(G.proximity(F.col("l_quantity") / 10, F.col("l_discount") * 10)).alias("near"))


@query("M08_coordinates", f"""WITH {BOX} SELECT ok, n, round(x1 / 100 * 1280, 4) AS px, round(y2 / 100 * 720, 4) AS py, round(x2 * 640 / 1280, 4) AS rx, round(y1 * 360 / 720, 4) AS ry,
CAST(greatest(0, least(trunc((x1 * 10 - x2 * 10 / 2) / 1000 * 1280), 1280)) AS INTEGER) AS cx1, CAST(greatest(0, least(trunc((y1 * 10 + y2 * 10 / 2) / 1000 * 720), 720)) AS INTEGER) AS cy2 FROM box""")
def m08(spark, d):
    w, h = F.lit(1280), F.lit(720)
    unit = F.transform("box", lambda v: v / 100)
    mils = F.transform("box", lambda v: v * 10)
    px, rs, ce = G.to_pixels(unit, w, h), G.rescale(F.col("box"), (w, h), (F.lit(640), F.lit(360))), G.from_centre(mils, w, h)
    return boxes(spark, d).select("ok", "n", F.round(G.at(px, 0), 4).alias("px"), F.round(G.at(px, 3), 4).alias("py"), F.round(G.at(rs, 2), 4).alias("rx"), F.round(G.at(rs, 1), 4).alias("ry"), G.at(ce, 0).alias("cx1"), G.at(ce, 3).alias("cy2"))


@query("M09_W01_centroid_area", f"WITH {BOX} SELECT ok, n, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy, round((x2 - x1) * (y2 - y1), 6) AS area, round(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)), 6) AS diag FROM box")
def m09(spark, d):
    b = F.col("box")
    return boxes(spark, d).select("ok", "n", r6(G.centroid(b)["x"]).alias("cx"), r6(G.centroid(b)["y"]).alias("cy"), r6(G.area(b)).alias("area"), r6(G.diagonal(b)).alias("diag"))


SQL_COMPASS = "['E','NE','N','NW','W','SW','S','SE'][CAST(floor((((degrees(atan2(-({dy}), {dx})) + 360) % 360) + 22.5) / 45) AS INTEGER) % 8 + 1]"
STEP = OBS + """, c AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS diag, (x2 - x1) * (y2 - y1) AS area FROM obox),
s AS (SELECT *, lead(cx) OVER w - cx AS dx, lead(cy) OVER w - cy AS dy, lead(t) OVER w - t AS dt, row_number() OVER w AS seq FROM c WINDOW w AS (PARTITION BY obj ORDER BY t, ord)),
m AS (SELECT *, sqrt(dx * dx + dy * dy) AS dist FROM s),
v AS (SELECT *, CASE WHEN dt IS NULL THEN NULL WHEN dt > 0 THEN dist / dt ELSE 0 END AS speed FROM m),
z AS (SELECT *, speed - lag(speed) OVER w AS speed_up, dx * lag(dx) OVER w + dy * lag(dy) OVER w AS turn FROM v WINDOW w AS (PARTITION BY obj ORDER BY t, ord))"""


@query("M10_compass", f"WITH {STEP} SELECT ord, {SQL_COMPASS.format(dx='dx', dy='dy')} AS bin FROM m WHERE dist >= 1e-9")
def m10(spark, d):
    return T.steps(observations(spark, d)).filter("dist >= 1e-9").select("ord", G.compass(F.col("dx"), F.col("dy")).alias("bin"))


SQL_SPEED = "CASE WHEN {v} < 0.02 THEN 'stationary' WHEN {v} < 0.10 THEN 'slow' WHEN {v} < 0.30 THEN 'moderate' ELSE 'fast' END"
SQL_SCALE = "CASE WHEN {a} < 1e-9 OR {b} < 1e-9 THEN 'stable' WHEN ln({b} / {a}) > 0.15 THEN 'approaching' WHEN ln({b} / {a}) < -0.15 THEN 'receding' ELSE 'stable' END"


@query("M11_speed_bin", f"SELECT l_orderkey AS ok, l_linenumber AS n, {SQL_SPEED.format(v='l_discount * 4')} AS bin FROM lineitem")
def m11(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("n"), G.speed_bin(F.col("l_discount") * 4).alias("bin"))


@query("M12_scale_bin", f"WITH {PAIR} SELECT ok, n, {SQL_SCALE.format(a='((ax2-ax1)*(ay2-ay1))', b='((bx2-bx1)*(by2-by1))')} AS bin FROM pair")
def m12(spark, d):
    return pairs(spark, d).select("ok", "n", G.scale_bin(G.area(F.col("a")), G.area(F.col("b"))).alias("bin"))


SUMMARY = STEP + f""", q AS (SELECT *, CASE WHEN dist >= 1e-9 THEN {SQL_COMPASS.format(dx='dx', dy='dy')} END AS bin FROM z),
votes AS (SELECT obj, bin, sum(dist) AS w, min(seq) AS first FROM q WHERE bin IS NOT NULL GROUP BY obj, bin),
lead AS (SELECT obj, bin AS lead FROM votes QUALIFY row_number() OVER (PARTITION BY obj ORDER BY w DESC, first) = 1),
u AS (SELECT obj, count(*) AS n, coalesce(sum(dist), 0) AS path, max(t) - min(t) AS seconds, avg(diag) AS diag,
 sqrt(power(last(cx ORDER BY t, ord) - first(cx ORDER BY t, ord), 2) + power(last(cy ORDER BY t, ord) - first(cy ORDER BY t, ord), 2)) AS net,
 first(area ORDER BY t, ord) AS a0, last(area ORDER BY t, ord) AS a1, count(*) FILTER (turn < 0) AS reversals, count(*) FILTER (speed_up > 0.005) AS faster,
 count(*) FILTER (speed_up < -0.005) AS slower, max(speed) AS top, min(speed_up) AS fall, max(speed_up) AS rise, coalesce(sum(dist) FILTER (dist >= 1e-9), 0) AS moved FROM q GROUP BY obj),
p AS (SELECT u.*, lead.lead, CASE WHEN seconds > 0 AND diag > 1e-9 THEN path / seconds / diag ELSE 0 END AS pace FROM u LEFT JOIN lead USING (obj)),
k AS (SELECT *, CASE WHEN n < 2 OR moved < 0.02 * diag OR lead IS NULL OR pace < 0.02 THEN 'STAT' ELSE lead END AS dir FROM p)"""
SQL_SHAPE = "CASE WHEN n < 3 THEN CASE WHEN dir = 'STAT' THEN 'stationary' ELSE 'linear' END WHEN path < 1e-9 THEN 'stationary' WHEN reversals / greatest(1, n - 2) > 0.4 THEN 'oscillating' WHEN net / path > 0.85 THEN 'linear' ELSE 'curved' END"
SQL_PHASE = "CASE WHEN n < 3 THEN 'constant' WHEN fall < -0.5 * top AND rise > 0.5 * top THEN 'reversing' WHEN faster > 0.6 * (n - 2) AND slower <= 0.2 * (n - 2) THEN 'accelerating' WHEN slower > 0.6 * (n - 2) AND faster <= 0.2 * (n - 2) THEN 'decelerating' ELSE 'constant' END"
DESCRIPTOR = f"WITH {SUMMARY} SELECT obj, n, dir, CASE WHEN dir = 'STAT' THEN 'stationary' ELSE {SQL_SPEED.format(v='pace')} END AS speed, CASE WHEN n < 2 THEN 'stable' ELSE {SQL_SCALE.format(a='a0', b='a1')} END AS scale, {SQL_SHAPE} AS shape, {SQL_PHASE} AS phase FROM k"


@query("trajectory_descriptor", DESCRIPTOR)
def trajectory_descriptor(spark, d):
    return T.descriptor(observations(spark, d))


@query("M13_shape", f"WITH {SUMMARY} SELECT obj, {SQL_SHAPE} AS shape FROM k")
def m13(spark, d):
    return T.descriptor(observations(spark, d)).select("obj", "shape")


@query("M14_phase", f"WITH {SUMMARY} SELECT obj, {SQL_PHASE} AS phase FROM k")
def m14(spark, d):
    return T.descriptor(observations(spark, d)).select("obj", "phase")


# The same descriptor by object and kind of event: short tracks, with singles among them.
@query("M15_descriptor_by_kind", DESCRIPTOR.replace("user_id AS obj", "user_id || '/' || event_type AS obj"))
def m15(spark, d):
    obs = observations(spark, d).withColumn("obj", F.concat_ws("/", F.col("obj").cast("string"), "kind"))
    return T.descriptor(obs)


PX = "greatest(0.02 * (sqrt(power(ax2-ax1,2)+power(ay2-ay1,2)) + sqrt(power(bx2-bx1,2)+power(by2-by1,2))) / 2, 3.0)"
DX, DY = "((bx1+bx2)/2 - (ax1+ax2)/2)", "((by1+by2)/2 - (ay1+ay2)/2)"


@query("M16_step_direction", f"WITH {PAIR} SELECT ok, n, CASE WHEN sqrt(power({DX},2) + power({DY},2)) < {PX} THEN 'STAT' ELSE {SQL_COMPASS.format(dx=DX, dy=DY)} END AS dir FROM pair")
def m16(spark, d):
    return pairs(spark, d).select("ok", "n", G.step_direction(F.col("a"), F.col("b")).alias("dir"))


@query("M17_step_speed", f"WITH {PAIR}, q AS (SELECT ok, n, n - 2 AS dt, sqrt(power({DX},2) + power({DY},2)) / nullif(n - 2, 0) / ((sqrt(power(ax2-ax1,2)+power(ay2-ay1,2)) + sqrt(power(bx2-bx1,2)+power(by2-by1,2))) / 2) AS v FROM pair) SELECT ok, n, CASE WHEN dt <= 0 THEN 'stationary' ELSE {SQL_SPEED.format(v='v')} END AS bin FROM q")
def m17(spark, d):
    return pairs(spark, d).select("ok", "n", G.step_speed(F.col("a"), F.col("b"), F.nullif(F.col("n") - 2, F.lit(0)).cast("double")).alias("bin")).withColumn("bin", F.when(F.col("n") <= 2, "stationary").otherwise(F.col("bin")))


@query("M18_word_direction", f"WITH {STEP} SELECT ord, CASE WHEN abs(dx) < 5 AND abs(dy) < 5 THEN 'stationary' WHEN abs(dx) > 1.5 * abs(dy) THEN CASE WHEN dx > 0 THEN 'right' ELSE 'left' END WHEN abs(dy) > 1.5 * abs(dx) THEN CASE WHEN dy > 0 THEN 'down' ELSE 'up' END ELSE (CASE WHEN dy > 0 THEN 'down' ELSE 'up' END) || '-' || (CASE WHEN dx > 0 THEN 'right' ELSE 'left' END) END AS dir FROM s WHERE dx IS NOT NULL")
def m18(spark, d):
    return T.steps(observations(spark, d)).filter("dx is not null").select("ord", G.word_direction(F.col("dx"), F.col("dy")).alias("dir"))


SQL_TEXT_DIR = "CASE WHEN sqrt(mx*mx + my*my) < 0.01 THEN 'stationary' WHEN abs(mx) > 0.02 AND abs(my) > 0.02 THEN (CASE WHEN my < 0 THEN 'up' ELSE 'down' END) || '-' || (CASE WHEN mx < 0 THEN 'left' ELSE 'right' END) WHEN abs(mx) > abs(my) THEN CASE WHEN mx < 0 THEN 'leftward' ELSE 'rightward' END ELSE CASE WHEN my < 0 THEN 'upward' ELSE 'downward' END END"


@query("M19_A27_text_direction", f"WITH {STEP}, a AS (SELECT obj, avg(dx) / 100 AS mx, avg(dy) / 100 AS my, avg(speed) FILTER (dt > 0) AS mean_speed FROM v GROUP BY obj) SELECT obj, {SQL_TEXT_DIR} AS dir, round(mean_speed, 6) AS mean_speed FROM a WHERE mx IS NOT NULL")
def m19(spark, d):
    df = T.steps(observations(spark, d)).groupBy("obj").agg((F.avg("dx") / 100).alias("mx"), (F.avg("dy") / 100).alias("my"), r6(F.avg(F.when(F.col("dt") > 0, F.col("speed")))).alias("mean_speed"))
    return df.filter("mx is not null").select("obj", G.text_direction(F.col("mx"), F.col("my")).alias("dir"), "mean_speed")


@query("M20_by_factor", "SELECT p_partkey AS k, CAST(round_even(p_size / 28.0, 0) * 28 AS BIGINT) AS near, CAST(ceil(p_size / 28.0) * 28 AS BIGINT) AS up, CAST(floor(p_size / 28.0) * 28 AS BIGINT) AS down FROM part")
def m20(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), *[G.by_factor(F.col("p_size"), 28, how).alias(name) for how, name in (("round", "near"), ("ceil", "up"), ("floor", "down"))])


H, WD = "(p_size * 20 + 20.0)", "(p_partkey % 700 + 30.0)"
RZ = f"greatest(28, round_even({{x}} / 28, 0) * 28)"
PIX = f"({RZ.format(x=H)} * {RZ.format(x=WD)})"
SIDE = "CAST(CASE WHEN {p} > 200704 THEN floor({x} / sqrt({h} * {w} / 200704) / 28) * 28 WHEN {p} < 3136 THEN ceil({x} * sqrt(3136 / ({h} * {w})) / 28) * 28 ELSE {r} END AS BIGINT)"


@query("M21_smart_resize", f"SELECT p_partkey AS k, {SIDE.format(p=PIX, x=H, h=H, w=WD, r=RZ.format(x=H))} AS h, {SIDE.format(p=PIX, x=WD, h=H, w=WD, r=RZ.format(x=WD))} AS w FROM part")
def m21(spark, d):
    size = G.smart_resize((F.col("p_size") * 20 + 20).cast("double"), (F.col("p_partkey") % 700 + 30).cast("double"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), size["h"].alias("h"), size["w"].alias("w"))


@query("M22_smart_frames", "SELECT p_partkey AS k, CAST(floor(least(least(greatest((p_size * 30 + 4) / 30.0 * 2, 4), floor(least(16, p_size * 30 + 4) / 2.0) * 2), p_size * 30 + 4) / 2) * 2 AS BIGINT) AS frames FROM part")
def m22(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), G.smart_frames(F.col("p_size") * 30 + 4, F.lit(30.0)).alias("frames"))


@query("M23_L11_frame_indices", """WITH p AS (SELECT p_partkey AS k, p_size * 17 + 1 AS n FROM part)
SELECT k, CASE WHEN trunc(n / 30.0) > 16 THEN array_to_string(list_transform(range(0, 16), lambda i: CAST(floor(i * (n - 1) / 15) AS INTEGER)), ',') ELSE array_to_string(list_slice(range(0, n, 30), 1, 16), ',') END AS frames FROM p""")
def m23(spark, d):
    n = F.col("p_size") * 17 + 1
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.array_join(G.frame_indices(n, F.lit(30.0)).cast("array<string>"), ",").alias("frames"))


@query("M24_duration_bucket", "SELECT p_partkey AS k, CASE WHEN p_size * 150 / 30.0 < 60 THEN 'Short' WHEN p_size * 150 / 30.0 < 180 THEN 'Medium' ELSE 'Long' END AS bucket FROM part")
def m24(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), G.duration_bucket(F.col("p_size") * 150.0, F.lit(30.0)).alias("bucket"))


BINS = "b AS (SELECT *, list_position(['E','NE','N','NW','W','SW','S','SE'], p) AS i, list_position(['E','NE','N','NW','W','SW','S','SE'], q) AS j FROM (SELECT l_orderkey AS ok, l_linenumber AS n, ['E','NE','N','NW','W','SW','S','SE','STAT'][CAST(l_quantity AS INTEGER) % 9 + 1] AS p, ['E','NE','N','NW','W','SW','S','SE','STAT'][l_suppkey % 9 + 1] AS q FROM lineitem))"


def bins(spark, d):
    names = F.array(*map(F.lit, [*G.COMPASS, "STAT"]))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("n"), F.element_at(names, F.col("l_quantity").cast("int") % 9 + 1).alias("p"), F.element_at(names, (F.col("l_suppkey") % 9 + 1).cast("int")).alias("q"))


@query("M25_direction_score", f"WITH {BINS} SELECT ok, n, CASE WHEN p = q THEN 1.0 WHEN i > 0 AND j > 0 AND least(abs(i - j), 8 - abs(i - j)) = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM b")
def m25(spark, d):
    return bins(spark, d).select("ok", "n", G.direction_score(F.col("p"), F.col("q")).alias("score"))


@query("M26_ordinal_score", "WITH b AS (SELECT *, list_position(['stationary','slow','moderate','fast'], p) AS i, list_position(['stationary','slow','moderate','fast'], q) AS j FROM (SELECT l_orderkey AS ok, l_linenumber AS n, ['stationary','slow','moderate','fast','warp'][CAST(l_quantity AS INTEGER) % 5 + 1] AS p, ['stationary','slow','moderate','fast','warp'][l_suppkey % 5 + 1] AS q FROM lineitem)) SELECT ok, n, CASE WHEN p = q THEN 1.0 WHEN i > 0 AND j > 0 AND abs(i - j) = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM b")
def m26(spark, d):
    names = F.array(*map(F.lit, [*G.SPEEDS, "warp"]))
    df = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("n"), F.element_at(names, F.col("l_quantity").cast("int") % 5 + 1).alias("p"), F.element_at(names, (F.col("l_suppkey") % 5 + 1).cast("int")).alias("q"))
    return df.select("ok", "n", G.ordinal_score(F.col("p"), F.col("q"), G.SPEEDS).alias("score"))


@query("M27_M29_words", "SELECT l_orderkey AS ok, l_linenumber AS n, CASE l_linenumber WHEN 2 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0.2 END::DOUBLE AS relevance, CASE WHEN l_tax * 5 < 0.1 THEN 'smooth' WHEN l_tax * 5 < 0.3 THEN 'jerky' ELSE 'erratic' END AS quality FROM lineitem")
def m27(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("n"), G.relevance(F.col("l_linenumber")).alias("relevance"), G.quality_word(F.col("l_tax") * 5).alias("quality"))


@query("M28_kl_estimate", "SELECT l_orderkey AS ok, round(avg(exp(x) - x - 1), 6) AS kl, round(avg(least(exp(x) * a, greatest(0.8, least(1.2, exp(x))) * a)), 6) AS clipped FROM (SELECT l_orderkey, greatest(-10, least(10, (l_discount - l_tax) * 200)) AS x, l_quantity / 50 - 0.5 AS a FROM lineitem) GROUP BY l_orderkey")
def m28(spark, d):
    x = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), (F.col("l_discount") - F.col("l_tax")) * 200))
    df = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ok"), x.alias("x"), (F.col("l_quantity") / 50 - 0.5).alias("a"))
    ratio = F.exp("x")
    return df.groupBy("ok").agg(r6(F.avg(ratio - F.col("x") - 1)).alias("kl"), r6(F.avg(F.least(ratio * F.col("a"), F.greatest(F.lit(0.8), F.least(F.lit(1.2), ratio)) * F.col("a")))).alias("clipped"))


@query("M30_M31_frame_at_time", "SELECT l_orderkey AS ok, l_linenumber AS n, CAST(trunc(l_quantity * 0.37 * 25) AS INTEGER) AS frame, CASE WHEN round_even(l_quantity * 0.37 * 25, 0) < 300 THEN CAST(round_even(l_quantity * 0.37 * 25, 0) AS INTEGER) END AS read FROM lineitem")
def m30(spark, d):
    f = F.col("l_quantity") * 0.37 * 25
    read = F.bround(f, 0).cast("int")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("n"), f.cast("int").alias("frame"), F.when(read < 300, read).alias("read"))


@query("M32_crop_box", f"WITH {BOX}, c AS (SELECT ok, n, greatest(0, least(trunc(x1 * 3 - 5), 24))::INTEGER AS x1, greatest(0, least(trunc(y1 * 3 - 5), 18))::INTEGER AS y1, greatest(0, least(trunc(x2 * 3 - 5), 24))::INTEGER AS x2, greatest(0, least(trunc(y2 * 3 - 5), 18))::INTEGER AS y2 FROM box) SELECT ok, n, CASE WHEN x2 > x1 AND y2 > y1 THEN concat_ws(',', x1, y1, x2, y2) END AS crop FROM c")
def m32(spark, d):
    box = F.transform("box", lambda v: v * 3 - 5)
    return boxes(spark, d).select("ok", "n", F.array_join(G.crop(box, F.lit(24), F.lit(18)).cast("array<string>"), ",").alias("crop"))


@query("W02_W03_steps", f"WITH {STEP} SELECT ord, round(dx, 6) AS dx, round(dy, 6) AS dy, round(dist, 6) AS dist, round(dt, 3) AS dt, round(speed, 6) AS speed FROM v WHERE dx IS NOT NULL")
def w02(spark, d):
    return T.steps(observations(spark, d)).filter("dx is not null").select("ord", *[r6(F.col(c)).alias(c) for c in ("dx", "dy", "dist")], F.round("dt", 3).alias("dt"), r6(F.col("speed")).alias("speed"))


@query("W04_speed_change", f"WITH {STEP} SELECT ord, round(speed_up, 6) AS speed_up FROM z WHERE speed_up IS NOT NULL")
def w04(spark, d):
    return T.steps(observations(spark, d)).filter("speed_up is not null").select("ord", r6(F.col("speed_up")).alias("speed_up"))


@query("W05_A28_acceleration", f"WITH {STEP}, f AS (SELECT obj, count(*) AS n, last(speed ORDER BY t, ord) AS b, first(speed ORDER BY t, ord) AS a, sum(dt) AS s FROM v WHERE dt > 0 GROUP BY obj) SELECT obj, round(CASE WHEN n >= 2 THEN (b - a) / s END, 9) AS accel FROM f")
def w05(spark, d):
    return T.acceleration(observations(spark, d)).select("obj", F.round("accel", 9).alias("accel"))


@query("W06_W07_reversals_sinuosity", f"WITH {SUMMARY} SELECT obj, reversals, round(reversals / greatest(1, n - 2), 6) AS ratio, round(net / nullif(path, 0), 6) AS sinuosity FROM k")
def w06(spark, d):
    df = T.summary(observations(spark, d))
    return df.select("obj", "reversals", r6(F.col("reversals") / F.greatest(F.lit(1), F.col("n") - 2)).alias("ratio"), r6(F.try_divide("net", "path")).alias("sinuosity"))


TWO = STEP + ", h AS (SELECT *, lag(dx) OVER w AS px, lag(dy) OVER w AS py FROM z WINDOW w AS (PARTITION BY obj ORDER BY t, ord)), g AS (SELECT *, sqrt(px*px + py*py) AS pm FROM h WHERE px IS NOT NULL AND dx IS NOT NULL)"


def successive(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("obj").orderBy("t", "ord")
    df = T.steps(observations(spark, d)).withColumns({"px": F.lag("dx").over(by), "py": F.lag("dy").over(by)}).filter("px is not null and dx is not null")
    return df.withColumn("pm", F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py")))


@query("W08_W09_direction_speed_fidelity", f"WITH {TWO} SELECT obj, round(coalesce(avg(((px*dx + py*dy) / (pm * dist) + 1) / 2) FILTER (pm > 0 AND dist > 0), 0), 6) AS cosine, round(avg(CASE WHEN pm = 0 AND dist = 0 THEN 1 WHEN pm = 0 OR dist = 0 THEN 0 ELSE least(pm, dist) / greatest(pm, dist) END), 6) AS fidelity FROM g GROUP BY obj")
def w08(spark, d):
    df = successive(spark, d)
    p, q = F.col("pm"), F.col("dist")
    cosine = F.when((p > 0) & (q > 0), ((F.col("px") * F.col("dx") + F.col("py") * F.col("dy")) / (p * q) + 1) / 2)
    fidelity = F.when((p == 0) & (q == 0), 1.0).when((p == 0) | (q == 0), 0.0).otherwise(F.least(p, q) / F.greatest(p, q))
    return df.groupBy("obj").agg(r6(F.coalesce(F.avg(cosine), F.lit(0.0))).alias("cosine"), r6(F.avg(fidelity)).alias("fidelity"))


@query("W10_smoothness", f"WITH {STEP} SELECT obj, round(coalesce(avg(least(greatest(dist - 500 / 30.0, 0) / (500 / 30.0), 1)) FILTER (dist IS NOT NULL), 0), 6) AS penalty FROM v GROUP BY obj")
def w10(spark, d):
    return T.smoothness(observations(spark, d)).select("obj", r6(F.col("penalty")).alias("penalty"))


@query("W11_A26_turn_angle", f"WITH {TWO} SELECT obj, round(avg(acos(greatest(-1, least(1, (px*dx + py*dy) / (pm * dist))))), 6) AS turn, round(stddev_pop(acos(greatest(-1, least(1, (px*dx + py*dy) / (pm * dist))))), 6) AS jitter FROM g WHERE pm > 0.01 AND dist > 0.01 GROUP BY obj")
def w11(spark, d):
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("px") * F.col("dx") + F.col("py") * F.col("dy")) / (F.col("pm") * F.col("dist")))))
    return successive(spark, d).filter("pm > 0.01 and dist > 0.01").groupBy("obj").agg(r6(F.avg(angle)).alias("turn"), r6(F.stddev_pop(angle)).alias("jitter"))


@query("W15_last_wins", "SELECT user_id AS obj, event_type AS kind, event_id AS ord, round(value, 6) AS x FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def w15(spark, d):
    return T.last_per_key(observations(spark, d), ["obj", "kind"], ["t", "ord"]).select("obj", "kind", "ord", r6(F.col("x")).alias("x"))


@query("W16_order_check", f"WITH {OBS} SELECT ord, round(coalesce(t - lag(t) OVER (PARTITION BY obj ORDER BY ord), 0), 3) AS gap, coalesce(t < lag(t) OVER (PARTITION BY obj ORDER BY ord), FALSE) AS out_of_order FROM obs")
def w16(spark, d):
    from pyspark.sql import Window

    before = F.lag("t").over(Window.partitionBy("obj").orderBy("ord"))
    return observations(spark, d).select("ord", F.round(F.coalesce(F.col("t") - before, F.lit(0.0)), 3).alias("gap"), F.coalesce(F.col("t") < before, F.lit(False)).alias("out_of_order"))
