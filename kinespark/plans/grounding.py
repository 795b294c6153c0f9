"""The grounded roll-up in full: all figures of both chains, and the items that meet each condition (A14, A15, A16, A34, R09 of
the survey). An order is an item, its lines are gold frames; answers are missing, empty, stated in text or malformed by key."""

from functools import cache

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinespark.operators import grounding as N
from kinespark.sources.tables import table

from .registry import query


def _items(spark, d):
    c, k = F.col, F.col("l_orderkey")
    x, y, q, h = F.round(c("l_discount") * 100), F.round(c("l_tax") * 100), c("l_quantity"), c("l_linenumber") * 5.0
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    frames = table(spark, d, "lineitem").select(k.alias("k"), i.alias("i"), x.alias("x"), y.alias("y"), q.alias("q"), h.alias("h"))
    gold = F.struct(c("i").alias("timestamp"), c("x").alias("xmin"), c("y").alias("ymin"), (c("x") + c("q")).alias("xmax"), (c("y") + c("h")).alias("ymax"))
    name = c("i").cast("string")
    one = F.when((c("i") + c("k")) % 4 != 0, F.struct(name, F.array(c("x") + 1, c("y") + 1, c("x") + c("q") + 1, c("y") + c("h") + 1)))
    side = F.array(c("x") + 2, c("y"), c("x") + c("q") + 2, c("y") + c("h"))
    two = F.when(c("i") % 3 != 0, F.struct(name, F.when((c("i") + c("k")) % 5 == 0, F.slice(side, 1, 3)).otherwise(side)))
    held = frames.groupBy("k").agg(F.collect_list(gold).alias("bboxes"), F.map_from_entries(F.collect_list(one)).alias("one"), F.map_from_entries(F.collect_list(two)).alias("two"))  # an order has few lines
    o, start = F.col("o_orderkey"), (F.col("o_custkey") % 50).cast("double")
    clock = lambda s: F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), (s % 60).cast("int"))
    said = F.when(o % 2 == 0, F.concat(F.lit("at 9 <answer> from "), clock(start + 1), F.lit(" to "), clock(start + 8), F.lit(" </answer>"))).otherwise("around <t>5</t>s")
    none = F.array().cast("array<double>")
    items = table(spark, d, "orders").join(held, o == F.col("k"), "left")
    return items.select(
        o.alias("item"),
        F.when(o % 7 != 0, o % 5 - 1).cast("int").alias("score"),
        F.array(start, start + 10).alias("timestamps"),
        F.coalesce("bboxes", F.array().cast("array<struct<timestamp:int,xmin:double,ymin:double,xmax:double,ymax:double>>")).alias("bboxes"),
        (F.col("o_custkey") % 250 * 30).alias("frame_count"),
        F.lit(30.0).alias("fps"),
        F.when(o % 11 != 0, F.col("o_orderpriority")).alias("domain"),
        F.when(o % 3 == 0, none).when(o % 3 == 1, F.array(start + 2, start + 9)).alias("answer_temporal"),
        said.alias("answer_temporal_pre"),
        F.when(o % 4 != 0, F.col("one")).alias("answer_spatial"),
        F.when(o % 3 == 0, F.array(start, start + 20)).when(o % 3 == 1, none).otherwise(F.array(F.lit(5.0))).alias("answer_temporal_2"),
        F.lit("3.5 and 12").alias("answer_temporal_pre_2"),
        F.col("two").alias("answer_spatial_2"),
    )


def _overlap(a, b):
    return f"CASE WHEN least({b}, s + 10) > greatest({a}, s) THEN (least({b}, s + 10) - greatest({a}, s)) / (greatest({b}, s + 10) - least({a}, s)) ELSE 0 END"


def _share(dx, dy):
    inter = f"greatest(q - {dx}, 0) * greatest(h - {dy}, 0)"
    return f"{inter} / (2 * q * h - {inter})"


MEASURED = f"""fr AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS i, l_quantity AS q, l_linenumber * 5.0 AS h FROM lineitem),
io AS (SELECT k, CASE WHEN k % 4 = 0 OR (i + k) % 4 = 0 THEN 0 ELSE {_share(1, 1)} END AS u, CASE WHEN i % 3 = 0 OR (i + k) % 5 = 0 THEN 0 ELSE {_share(2, 0)} END AS v FROM fr),
sp AS (SELECT k, avg(u) AS miou, avg(v) AS miou_2, {", ".join(f"avg(CAST({c} >= {t} AS INTEGER)) AS ap_{int(t * 100)}{e}" for c, e in (("u", ""), ("v", "_2")) for t in N.PRECISIONS)} FROM io GROUP BY k),
it AS (SELECT o_orderkey AS item, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 5 - 1 END AS score, (o_custkey % 50)::DOUBLE AS s, (o_custkey % 250)::DOUBLE AS len, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority ELSE 'unknown' END AS domain FROM orders),
ms AS (SELECT it.*, CASE WHEN len < 60 THEN 'Short' WHEN len < 180 THEN 'Medium' ELSE 'Long' END AS duration, {_overlap("0", "len")} AS rand_tiou,
  CASE WHEN item % 3 = 1 THEN {_overlap("s + 2", "s + 9")} WHEN item % 6 = 0 THEN {_overlap("s + 1", "s + 8")} ELSE 0 END::DOUBLE AS tiou, CASE item % 3 WHEN 0 THEN {_overlap("s", "s + 20")} WHEN 1 THEN {_overlap("3.5", "12")} ELSE 0 END::DOUBLE AS tiou_2,
  {", ".join(f"coalesce({c}, 0)::DOUBLE AS {c}" for c in ["miou", "miou_2"] + [f"ap_{int(t * 100)}{e}" for e in N.CHAINS for t in N.PRECISIONS])} FROM it LEFT JOIN sp ON sp.k = it.item)"""


def _holds(n, c):
    need = {1: "score >= 2", 2: f"tiou{c} >= 0.3", 4: f"miou{c} >= 0.1"}
    return " AND ".join(t for b, t in need.items() if N.CONDITIONS[n] & b)


@cache
def _sql():
    fig = ["count(*) AS items", "count(score) AS answered", "avg(greatest(score, 0)) FILTER (score IS NOT NULL) AS all_score", "coalesce(avg(score) FILTER (score <> -1), 0) AS valid_score", "count(*) FILTER (score >= 2) / {total} AS accuracy", "avg(rand_tiou) FILTER (score IS NOT NULL) AS rand_tiou"]
    for c in N.CHAINS:
        fig += [f"avg(CAST(tiou{c} >= {t} AS INTEGER)) FILTER (score IS NOT NULL) AS r1_{int(t * 100)}{c}" for t in N.RECALLS]
        fig += [f"avg({m}{c}) FILTER (score IS NOT NULL) AS {m}{c}" for m in ("tiou", "miou", *[f"ap_{int(t * 100)}" for t in N.PRECISIONS])]
        fig += [f"count(*) FILTER (score IS NOT NULL AND {_holds(n, c)}) / {{total}} AS {n}{c}" for n in N.CONDITIONS]
    total = "(CASE WHEN grouping(duration) + grouping(domain) = 2 THEN count(*) ELSE count(score) END)::DOUBLE"
    names = [f.rsplit(" AS ", 1)[1] for f in fig]
    gap = lambda c: f"-(ln(1 - accuracy) + ln(1 - tiou{c}) + ln(1 - miou{c})) / 3"
    mean = lambda c: f"(accuracy + tiou{c} + miou{c}) / 3"
    more = [f"{mean(c)} AS am{c}, {gap(c)} AS lgm{c}" for c in N.CHAINS] + [f"({mean('')} + {mean('_2')}) / 2 AS mam, ({gap('')} + {gap('_2')}) / 2 AS mlgm"]
    rounded = [f"round({n}, 6) AS {n}" for n in (*names, *[f"{m}{c}" for m in ("am", "lgm") for c in N.CHAINS], "mam", "mlgm") if n not in ("items", "answered")]
    return f"WITH {MEASURED}, st AS (SELECT CASE WHEN grouping(duration) = 0 THEN 'duration' WHEN grouping(domain) = 0 THEN 'domain' ELSE 'overall' END AS dimension, coalesce(duration, domain) AS value, {', '.join(fig).format(total=total)} FROM ms GROUP BY GROUPING SETS ((duration), (domain), ()) HAVING count(score) > 0), al AS (SELECT *, {', '.join(more)} FROM st) SELECT dimension, value, items, answered, {', '.join(rounded)} FROM al"


@query("A14_A15_A34_grounded_rollup", _sql())
def a14(spark, d):
    out = N.statistics(N.measured(_items(spark, d)))
    return out.select("dimension", "value", "items", "answered", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("dimension", "value", "items", "answered")])


@query("A16_items_by_condition", f"WITH {MEASURED} " + " UNION ALL ".join(f"SELECT {k + 1} AS chain, '{n}' AS condition, item FROM ms WHERE score IS NOT NULL AND {_holds(n, c)}" for k, c in enumerate(N.CHAINS) for n in N.CONDITIONS))
def a16(spark, d):
    return N.meeting(N.measured(_items(spark, d)), "item")
