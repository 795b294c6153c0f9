"""Aggregates, windows over groups, limits and set operations (A, W, L, U of the survey)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinespark.operators import benchmarks as B
from kinespark.operators import ordering
from kinespark.operators import rollup as R
from kinespark.sources.shared import shared_path
from kinespark.sources.tables import OBS, observations, table

from .registry import query

r6 = lambda c: F.round(c, 6)
n_ = lambda: F.count(F.lit(1))
#: Sightings in a piece of a track.
PIECE = 1024


@query("A01_trajectory_build", f"WITH {OBS} SELECT obj, kind, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY t, ord) AS track FROM obs GROUP BY obj, kind")
def a01(spark, d):
    # A row is a whole track, of any length: its sightings are cut in pieces by row numbers, and the pieces' texts joined.
    held = ordering.pieces(observations(spark, d).select("obj", "kind", "t", "ord"), ["obj", "kind"], [F.col("t"), F.col("ord")], PIECE)
    said = lambda of: F.nullif(F.array_join(F.transform(F.sort_array(F.collect_list(of)), lambda x: x["text"]), ","), F.lit(""))
    df = held.groupBy("obj", "kind", "piece").agg(said(F.struct("place", F.col("ord").cast("string").alias("text"))).alias("text"))
    return df.groupBy("obj", "kind").agg(said(F.struct("piece", "text")).alias("track"))


SOURCES = "SELECT source, count(l.doc_id) AS found, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source"


@query("A02_L04_source_census", f"SELECT * FROM ({SOURCES}) ORDER BY missing DESC, source LIMIT 15")
def a02(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("hit")), "doc_id", "left")
    df = df.groupBy("source").agg(F.count_if(F.col("hit")).alias("found"), F.count_if(F.col("hit").isNull()).alias("missing"))
    return df.orderBy(F.col("missing").desc(), "source").limit(15)


SC = "s AS (SELECT l_orderkey AS ok, l_linenumber AS n, l_discount * 10 AS reward, l_quantity / 50 AS a, l_tax * 12 AS b, l_returnflag AS rf, l_linestatus AS ls, CAST(l_suppkey % 3 AS VARCHAR) AS dom FROM lineitem)"


def scored(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("n"), (F.col("l_discount") * 10).alias("reward"), (F.col("l_quantity") / 50).alias("a"), (F.col("l_tax") * 12).alias("b"), F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"), (F.col("l_suppkey") % 3).cast("string").alias("dom"))


@query("A03_A04_mean_overlap", f"WITH {SC} SELECT ok, round(coalesce(avg(a) FILTER (a > 0.5), 0), 6) AS matched_mean, round(sum(CASE WHEN a > 0.5 THEN a ELSE 0 END) / count(*), 6) AS all_mean FROM s GROUP BY ok")
def a03(spark, d):
    hit = F.when(F.col("a") > 0.5, F.col("a"))
    return scored(spark, d).groupBy("ok").agg(r6(F.coalesce(F.avg(hit), F.lit(0.0))).alias("matched_mean"), r6(F.sum(F.coalesce(hit, F.lit(0.0))) / n_()).alias("all_mean"))


@query("A05_composite_score", f"WITH {SC} SELECT ok, n, round(greatest(0, least(1, .25 * a + .15 * b + .35 * (.4 * a + .4 * b + .2 * reward) + .20 * (.6 * a + .4 * b))), 6) AS total FROM s")
def a05(spark, d):
    a, b, c = F.col("a"), F.col("b"), F.col("reward")
    total = 0.25 * a + 0.15 * b + 0.35 * (0.4 * a + 0.4 * b + 0.2 * c) + 0.20 * (0.6 * a + 0.4 * b)
    return scored(spark, d).select("ok", "n", r6(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))).alias("total"))


@query("A06_object_mean", f"WITH {SC} SELECT ok, round(coalesce(avg(a) FILTER (rf <> 'N'), CASE WHEN count(*) >= 2 THEN 0.1 ELSE 0 END), 6) AS reward FROM s GROUP BY ok")
def a06(spark, d):
    return scored(spark, d).groupBy("ok").agg(r6(F.coalesce(F.avg(F.when(F.col("rf") != "N", F.col("a"))), F.when(n_() >= 2, 0.1).otherwise(0.0))).alias("reward"))


@query("A07_W12_advantage", f"WITH {SC} SELECT ok, n, round(reward, 6) AS reward, round((reward - avg(reward) OVER w) / (stddev_samp(reward) OVER w + 1e-4), 5) AS advantage FROM s WINDOW w AS (PARTITION BY ok)")
def a07(spark, d):
    return R.advantages(scored(spark, d), ["ok"], "reward").select("ok", "n", r6(F.col("reward")).alias("reward"), F.round("advantage", 5).alias("advantage"))


@query("A08_A09_group_ratios", f"WITH {SC}, g AS (SELECT ok, bool_and(reward + a + b <= 1) AS wrong, bool_and(reward + a + b >= 1.5) AS correct FROM s GROUP BY ok) SELECT round(avg(CAST(wrong AS INTEGER)), 6) AS all_wrong, round(avg(CAST(correct AS INTEGER)), 6) AS all_correct FROM g")
def a08(spark, d):
    total = F.col("reward") + F.col("a") + F.col("b")
    g = scored(spark, d).groupBy("ok").agg(F.bool_and(total <= 1).alias("wrong"), F.bool_and(total >= 1.5).alias("correct"))
    return g.agg(r6(F.avg(F.col("wrong").cast("double"))).alias("all_wrong"), r6(F.avg(F.col("correct").cast("double"))).alias("all_correct"))


@query("A10_rollup_accuracy", f"WITH {SC} SELECT rf, count(*) AS total, count(*) FILTER (a > 0.5) AS correct, round(100.0 * count(*) FILTER (a > 0.5) / count(*), 2) AS accuracy FROM s GROUP BY ROLLUP (rf)")
def a10(spark, d):
    hit = F.count_if(F.col("a") > 0.5)
    return scored(spark, d).rollup("rf").agg(n_().alias("total"), hit.alias("correct"), F.round(100.0 * hit / n_(), 2).alias("accuracy"))


DIMS = ("rf", "ls", "dom")
GS = "SELECT CASE WHEN grouping(rf) = 0 THEN 'rf' WHEN grouping(ls) = 0 THEN 'ls' WHEN grouping(dom) = 0 THEN 'dom' ELSE 'overall' END AS dimension, coalesce(rf, ls, dom) AS value, {agg} FROM s GROUP BY GROUPING SETS ((rf), (ls), (dom), ())"


@query("A11_grouping_sets", f"WITH {SC} " + GS.format(agg="count(*) AS n, round(avg(CAST(a > 0.5 AS INTEGER)), 6) AS accuracy"))
def a11(spark, d):
    return R.grouping_sets(scored(spark, d), list(DIMS), [n_().alias("n"), r6(F.avg((F.col("a") > 0.5).cast("double"))).alias("accuracy")])


@query("A12_A35_weighted_mean", f"WITH {SC}, g AS (SELECT rf, dom, count(*) AS n, avg(CAST(a > 0.5 AS INTEGER)) AS acc FROM s GROUP BY rf, dom) SELECT rf, round(sum(acc * n) / sum(n), 5) AS accuracy, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY ROLLUP (rf)")
def a12(spark, d):
    # A mean of group means weighted by size is the mean of all rows.
    return scored(spark, d).rollup("rf").agg(F.round(F.avg((F.col("a") > 0.5).cast("double")), 5).alias("accuracy"), n_().alias("n"))


SLICES = ["rf", "ls", "dom", "grade"]
RATED = f"WITH {SC}, y AS (SELECT CASE WHEN n % 4 = 0 THEN -1 ELSE a END AS v, CAST(n AS VARCHAR) AS dur, rf, ls, dom, CASE WHEN reward > 0.5 THEN 'high' END AS grade, ['odd' || (n % 2), 'x' || (ok % 3)] AS cls FROM s), e AS (SELECT dur, v, 'overall' AS slice, NULL AS value FROM y " + " ".join(f"UNION ALL SELECT dur, v, '{c}', {c} FROM y" for c in SLICES) + " UNION ALL SELECT dur, v, 'cls', unnest(cls) FROM y) SELECT coalesce(dur, 'overall') AS dur, slice, {value} AS value, CASE WHEN count(*) FILTER (v >= 0) = 0 THEN 'nan' ELSE printf('%.3f', avg(v) FILTER (v >= 0)) END AS rating FROM e GROUP BY GROUPING SETS ((dur, slice, value), (slice, value))"


def _rated(spark, d):
    n = F.col("n")
    df = scored(spark, d).withColumns({"v": F.when(n % 4 == 0, F.lit(-1.0)).otherwise(F.col("a")), "dur": n.cast("string"), "grade": F.when(F.col("reward") > 0.5, "high")})
    df = df.withColumn("cls", F.array(F.concat(F.lit("odd"), (n % 2).cast("string")), F.concat(F.lit("x"), (F.col("ok") % 3).cast("string"))))
    return B.ratings(df, "dur", SLICES, "cls", "v")


@query("A13_ratings_by_slice", RATED.replace("{value}", "value"))
def a13(spark, d):
    return _rated(spark, d)


@query("K04_rating_report", RATED.replace("{value}", "coalesce(value, '')"))
def k04(spark, d):
    path = shared_path(spark, "rating")
    B.rating_report(_rated(spark, d), "dur").write.json(path)
    held = spark.read.schema("dur string, report string").json(path)
    held = held.select("dur", F.explode(F.from_json("report", "map<string,map<string,string>>")).alias("slice", "m"))
    return held.select("dur", "slice", F.explode("m").alias("value", "rating"))


@query("A15_log_gap_mean", f"WITH {SC}, g AS (SELECT rf, avg(reward) * .9 AS x, avg(a) * .9 AS y, avg(b) * .9 AS z FROM s GROUP BY rf) SELECT rf, round(-(ln(1 - x) + ln(1 - y) + ln(1 - z)) / 3, 6) AS lgm FROM g")
def a15(spark, d):
    g = scored(spark, d).groupBy("rf").agg(*[(F.avg(c) * 0.9).alias(k) for c, k in (("reward", "x"), ("a", "y"), ("b", "z"))])
    return g.select("rf", r6(-(F.ln(1 - F.col("x")) + F.ln(1 - F.col("y")) + F.ln(1 - F.col("z"))) / 3).alias("lgm"))


@query("A17_confusion", "SELECT l_returnflag AS gt, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag")
def a17(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("gt")).pivot("l_linestatus", ["F", "O"]).count().na.fill(0)


@query("A18_attribute_accuracy", "SELECT count(*) AS gt, count(quality) AS matched, round(avg(CAST(quality = toxic AS INTEGER)), 6) AS of_matched, round(count(*) FILTER (quality = toxic) * 1.0 / count(*), 6) AS of_all FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def a18(spark, d):
    df = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    same = F.col("quality") == F.col("toxic")
    return df.agg(n_().alias("gt"), F.count("quality").alias("matched"), r6(F.avg(same.cast("double"))).alias("of_matched"), r6(F.count_if(same) / n_()).alias("of_all"))


@query("A19_tag_census", "WITH t AS (SELECT '<motion dir=\"' || event_type || '\" speed=\"' || (event_id % 4) || '\"/>' AS s FROM events), m AS (SELECT unnest(regexp_extract_all(s, '(\\w+)=\"([^\"]*)\"', 1)) AS attr, unnest(regexp_extract_all(s, '(\\w+)=\"([^\"]*)\"', 2)) AS val FROM t) SELECT attr, val, count(*) AS n FROM m GROUP BY attr, val")
def a19(spark, d):
    s = F.format_string('<motion dir="%s" speed="%d"/>', F.col("event_type"), (F.col("event_id") % 4).cast("int"))
    pattern = F.lit('(\\w+)="([^"]*)"')
    df = table(spark, d, "events").select(F.explode(F.arrays_zip(F.regexp_extract_all(s, pattern, F.lit(1)).alias("a"), F.regexp_extract_all(s, pattern, F.lit(2)).alias("v"))).alias("m"))
    return df.groupBy(F.col("m.a").alias("attr"), F.col("m.v").alias("val")).agg(n_().alias("n"))


PCT = [5, 10, 25, 33, 50, 66, 75, 90, 95]


@query("A20_nearest_rank", "WITH v AS (SELECT event_type AS kind, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT kind, " + ", ".join(f"round(max(value) FILTER (i = least(floor(n * {p} / 100.0), n - 1)), 6) AS p{p}" for p in PCT) + " FROM v GROUP BY kind")
def a20(spark, d):
    out = R.nearest_rank(table(spark, d, "events").select(F.col("event_type").alias("kind"), "value"), ["kind"], "value", PCT)
    return out.select("kind", *[r6(F.col(f"p{p}")).alias(f"p{p}") for p in PCT])


@query("A21_A08_counters", "SELECT count(*) AS total, count(*) FILTER (n_chars > 2000) AS augmented, round(100.0 * count(*) FILTER (n_chars > 2000) / count(*), 2) AS pct FROM documents")
def a21(spark, d):
    big = F.count_if(F.col("n_chars") > 2000)
    return table(spark, d, "documents").agg(n_().alias("total"), big.alias("augmented"), F.round(100.0 * big / n_(), 2).alias("pct"))


@query("A22_Q13_L07_vote", "WITH s AS (SELECT user_id AS k, event_type, sum(floor(value)) AS w FROM events GROUP BY 1, 2) SELECT k, event_type AS winner, w AS score FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY w DESC, event_type) = 1")
def a22(spark, d):
    df = table(spark, d, "events").select(F.col("user_id").alias("k"), "event_type", F.floor("value").cast("double").alias("w"))
    return R.weighted_vote(df, ["k"], "event_type", "w")


@query("A25_U03_token_sets", "WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS a, list_distinct(regexp_extract_all(lower(role || ' the and of'), '[a-z]+')) AS b FROM conversations) SELECT conv_id, turn, CAST(len(a) AS INTEGER) AS na, CAST(len(list_intersect(a, b)) AS INTEGER) AS both, CAST(len(list_distinct(list_concat(a, b))) AS INTEGER) AS either FROM t")
def a25(spark, d):
    tok = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    df = table(spark, d, "conversations").select("conv_id", "turn", tok(F.col("text")).alias("a"), tok(F.concat("role", F.lit(" the and of"))).alias("b"))
    return df.select("conv_id", "turn", F.size("a").alias("na"), F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_union("a", "b")).alias("either"))


@query("A29_sign_histogram", "SELECT CASE WHEN x > 0.01 THEN 'faster' WHEN x < -0.01 THEN 'slower' ELSE 'steady' END AS sign, count(*) AS n FROM (SELECT TRY_CAST(regexp_extract('accel: ' || printf('%+.3f', (value - 50) / 1000) || ' units', 'accel: ([+-][0-9.]+)', 1) AS DOUBLE) AS x FROM events) GROUP BY 1")
def a29(spark, d):
    text = F.concat(F.lit("accel: "), F.format_string("%+.3f", (F.col("value") - 50) / 1000), F.lit(" units"))
    x = F.regexp_extract(text, "accel: ([+-][0-9.]+)", 1).cast("double")
    return table(spark, d, "events").groupBy(F.when(x > 0.01, "faster").when(x < -0.01, "slower").otherwise("steady").alias("sign")).agg(n_().alias("n"))


@query("A30_tag_quality", "SELECT count(*) AS samples, count(*) FILTER (event_id % 7 > 0 AND event_id % 5 > 0) AS with_motion, sum(CASE WHEN event_id % 7 > 0 THEN event_id % 5 ELSE 0 END)::BIGINT AS tags, sum(CASE WHEN event_id % 7 IN (1, 2) THEN event_id % 5 ELSE 0 END)::BIGINT AS single_frame, sum(CASE WHEN event_id % 7 = 3 THEN event_id % 5 ELSE 0 END)::BIGINT AS stationary, sum(CASE WHEN event_id % 7 > 3 THEN event_id % 5 ELSE 0 END)::BIGINT AS moving FROM events")
def a30(spark, d):
    e = F.col("event_id")
    said = F.when(e % 7 == 1, "stationary (single frame)").when(e % 7 == 2, "single frame").when(e % 7 == 3, "stationary (no significant motion)").otherwise("rightward motion")
    tags = F.repeat(F.concat(F.lit("then <motion>"), said, F.lit("</motion> ")), (e % 5).cast("int"))
    text = F.when(e % 7 > 0, F.concat(F.lit("<motion></motion> "), tags, F.lit("<motion>not < closed")))
    return table(spark, d, "events").agg(*B.tag_quality(text))


@query("A31_A33_batch_summary", f"WITH {SC} SELECT round(avg(reward), 6) AS mean, count(*) FILTER (reward > 0) AS positive, round(avg(reward) FILTER (reward > 0), 6) AS mean_positive FROM s")
def a33(spark, d):
    pos = F.col("reward") > 0
    return scored(spark, d).agg(r6(F.avg("reward")).alias("mean"), F.count_if(pos).alias("positive"), r6(F.avg(F.when(pos, F.col("reward")))).alias("mean_positive"))


@query("A32_masked_mean", f"WITH {SC}, g AS (SELECT ok, sum(a * CAST(n <= 3 AS INTEGER)) / sum(CAST(n <= 3 AS INTEGER)) AS m FROM s GROUP BY ok HAVING sum(CAST(n <= 3 AS INTEGER)) > 0) SELECT round(avg(m), 6) AS loss FROM g")
def a32(spark, d):
    keep = (F.col("n") <= 3).cast("double")
    g = scored(spark, d).groupBy("ok").agg(F.try_divide(F.sum(F.col("a") * keep), F.sum(keep)).alias("m"))
    return g.agg(r6(F.avg("m")).alias("loss"))


@query("W13_cap_per_subset", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3")
def w13(spark, d):
    return R.cap_per_group(table(spark, d, "documents").select("source", "doc_id"), "source", ["doc_id"], 3)


@query("W14_mask_after_eos", f"WITH {OBS}, f AS (SELECT obj, min(struct_pack(t := t, o := ord)) FILTER (kind = 'purchase') AS e FROM obs GROUP BY obj) SELECT ord, CAST(e IS NULL OR struct_pack(t := t, o := ord) <= e AS INTEGER) AS mask FROM obs JOIN f USING (obj)")
def w14(spark, d):
    by = Window.partitionBy("obj").orderBy("t", "ord").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max((F.col("kind") == "purchase").cast("int")).over(by), F.lit(0))
    return observations(spark, d).select("ord", (1 - before).alias("mask"))


@query("W17_first_winner", "WITH m AS (SELECT source, min(doc_id) AS doc_id FROM documents WHERE lang = 'en' GROUP BY source) SELECT source, doc_id, text AS head FROM m JOIN documents USING (source, doc_id)")
def w17(spark, d):
    df = table(spark, d, "documents").filter("lang = 'en'").groupBy("source").agg(F.min_by(F.struct("doc_id", F.col("text").alias("head")), "doc_id").alias("m"))
    return df.select("source", "m.doc_id", "m.head")


@query("L01_L08_sorted_report", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY segment")
def l01(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(n_().alias("n")).orderBy("segment")


@query("L02_head", "SELECT o_orderkey AS k, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def l02(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price")).orderBy(F.col("price").desc(), "k").limit(25)


@query("L03_multiple_of_four", "WITH r AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS i, count(*) OVER () AS n FROM conversations) SELECT conv_id, turn FROM r WHERE i <= n - n % 4")
def l03(spark, d):
    # Only the rows cut off are ranked: at most three, taken from the end.
    df = table(spark, d, "conversations").select("conv_id", "turn")
    extra = df.count() % 4
    last = df.orderBy(F.col("conv_id").desc(), F.col("turn").desc()).limit(extra)
    return df.join(last, ["conv_id", "turn"], "left_anti")


@query("L05_L06_seeded_shuffle")
def l05(spark, d):
    df = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.xxhash64(F.lit(42), "o_orderkey").alias("place"))
    return df.orderBy("place", "k").limit(50).select("k")


@query("L09_index_selection", "SELECT o_orderkey AS k FROM orders WHERE o_orderkey IN (1, 5, 33, 77, 1000000000)")
def l09(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderkey").isin(1, 5, 33, 77, 1_000_000_000)).select(F.col("o_orderkey").alias("k"))


@query("L10_cap_list", "SELECT l_orderkey AS ok, CASE WHEN count(*) > 5 THEN '' ELSE string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) END AS crops FROM lineitem GROUP BY l_orderkey")
def l10(spark, d):
    df = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ok")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("l"))
    few = F.when(F.size("l") > 5, F.array().cast("array<int>")).otherwise(F.col("l"))
    return df.select("ok", F.array_join(few.cast("array<string>"), ",").alias("crops"))


@query("U01_U02_union_all", "SELECT 'event' AS part, event_id AS k FROM events UNION ALL SELECT 'order', o_orderkey FROM orders")
def u01(spark, d):
    a = table(spark, d, "events").select(F.lit("event").alias("part"), F.col("event_id").alias("k"))
    return a.unionByName(table(spark, d, "orders").select(F.lit("order").alias("part"), F.col("o_orderkey").alias("k")))


@query("U04_distinct_list", "SELECT user_id AS k, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def u04(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))


@query("U05_map_merge", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS a FROM orders")
def u05(spark, d):
    old = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("keep"))
    new = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>"))
    # Later keys win, whatever the session's policy for repeated keys.
    merged = F.map_zip_with(old, new, lambda k, x, y: F.coalesce(y, x))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), merged["a"].alias("a"))


@query("U07_distinct_frames", "SELECT l_orderkey AS ok, count(DISTINCT l_shipdate) >= 2 AS enough FROM lineitem GROUP BY l_orderkey")
def u07(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ok")).agg((F.count_distinct("l_shipdate") >= 2).alias("enough"))
