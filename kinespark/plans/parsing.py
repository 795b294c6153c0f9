"""Queries on text: similarities, formats and parsers (T and R of the survey), and projections (P)."""

from pyspark.sql import functions as F

from kinespark.functions import parse as P
from kinespark.functions import text as X
from kinespark.operators import benchmarks as B
from kinespark.sources.tables import table

from .registry import query

r6 = lambda c: F.round(c, 6)
S = lambda c: F.col(c).cast("string")
DIRS, SPD, SCL = ("E", "NE", "UP", "STAT"), ("slow", "fast", "warp"), ("stable", "approaching")

#: A tagged answer for each event, in both engines.
TXT = """x AS (SELECT event_id AS id, '<think> <obj>User ' || user_id || '!</obj><box>[' || CAST(floor(value) AS INTEGER) || ', 2, 90, 95' || CASE WHEN event_id % 5 = 0 THEN '' ELSE ']' END || '</box>at<t>' || CASE WHEN event_id % 7 = 0 THEN 'x' ELSE (event_id % 60) || '.5' END || '</t>s then <motion obj="User ' || (user_id % 4) || '" dir="' || ['E','NE','UP','STAT'][event_id % 4 + 1] || '" speed="' || ['slow','fast','warp'][event_id % 3 + 1] || '" scale="' || ['stable','approaching'][event_id % 2 + 1] || '"/><motion>' || ['upward','rightward','stationary','up-left'][event_id % 4 + 1] || ' motion</motion></think>' || CASE WHEN event_id % 11 = 0 THEN '' ELSE '<answer> ' || ['A','B','(C)','D.'][event_id % 4 + 1] || ' </answer>' END AS s FROM events)"""


def answers(spark, d):
    pick = lambda names, m: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % m + 1).cast("int"))
    e = F.col("event_id")
    s = F.concat(
        F.lit("<think> <obj>User "), S("user_id"), F.lit("!</obj><box>["), F.floor("value").cast("int").cast("string"), F.lit(", 2, 90, 95"), F.when(e % 5 == 0, "").otherwise("]"), F.lit("</box>at<t>"),
        F.when(e % 7 == 0, "x").otherwise(F.concat((e % 60).cast("string"), F.lit(".5"))), F.lit('</t>s then <motion obj="User '), (F.col("user_id") % 4).cast("string"), F.lit('" dir="'), pick(DIRS, 4), F.lit('" speed="'), pick(SPD, 3), F.lit('" scale="'), pick(SCL, 2),
        F.lit('"/><motion>'), pick(("upward", "rightward", "stationary", "up-left"), 4), F.lit(" motion</motion></think>"), F.when(e % 11 == 0, "").otherwise(F.concat(F.lit("<answer> "), pick(("A", "B", "(C)", "D."), 4), F.lit(" </answer>"))),
    )
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", s.alias("s"))


@query("T01_normal_name", "SELECT p_partkey AS k, trim(regexp_replace(regexp_replace(lower(p_name || '-' || p_brand), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM part")
def t01(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), X.normal_name(F.concat("p_name", F.lit("-"), "p_brand")).alias("name"))


@query("T02_clean_text", "SELECT item_id, trim(trim(regexp_replace(regexp_replace(replace('♪ ' || text || ' ♫ @@', '♪', ''), '[^\\p{L}\\p{N}_\\s.,!?:;\\-''\"()\\[\\]]', '', 'g'), '\\s+', ' ', 'g')), '.,;:') AS clean FROM benchmark")
def t02(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.clean_text(F.concat(F.lit("♪ "), "text", F.lit(" ♫ @@"))).alias("clean"))


@query("T03_first_number", "SELECT event_id AS id, TRY_CAST(regexp_extract('about ' || CAST(floor(value) AS INTEGER) || '.25 units', '-?\\d+(?:\\.\\d+)?', 0) AS DOUBLE) AS n FROM events")
def t03(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), X.first_number(F.concat(F.lit("about "), F.floor("value").cast("int").cast("string"), F.lit(".25 units"))).alias("n"))


TOK = "list_filter(string_split_regex(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')"
TURNS = "p AS (SELECT a.conv_id, a.turn, a.text AS q, b.text AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def turns(spark, d):
    df = table(spark, d, "conversations")
    nxt = df.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("r"))
    return df.select("conv_id", "turn", F.col("text").alias("q")).join(nxt, ["conv_id", "turn"])


@query("T05_T06_token_f1", f"WITH {TURNS}, t AS (SELECT conv_id, turn, list_distinct({TOK.format(c='q')}) AS a, list_distinct({TOK.format(c='r')}) AS b FROM p) SELECT conv_id, turn, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS f1 FROM t")
def t05(spark, d):
    return turns(spark, d).select("conv_id", "turn", r6(X.token_f1(F.col("q"), F.col("r"))).alias("f1"))


@query("T04_simple_accuracy", f"WITH {TURNS}, c AS (SELECT conv_id, turn, q, CASE WHEN turn % 3 = 0 THEN r ELSE regexp_replace(q, '\\s+\\S+$', '') END AS o FROM p), t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(trim(lower(q)), '\\s+'), lambda w: w <> '')) AS a, list_distinct(list_filter(string_split_regex(trim(lower(o)), '\\s+'), lambda w: w <> '')) AS b, trim(lower(q)) AS x, trim(lower(o)) AS y FROM c) SELECT conv_id, turn, CASE WHEN x = y OR len(list_intersect(a, b)) * 1.0 / len(list_distinct(list_concat(a, b))) >= 0.6 THEN 1.0 ELSE 0.0 END::DOUBLE AS acc FROM t")
def t04(spark, d):
    other = F.when(F.col("turn") % 3 == 0, F.col("r")).otherwise(F.regexp_replace("q", "\\s+\\S+$", ""))
    return turns(spark, d).select("conv_id", "turn", X.simple_accuracy(F.col("q"), other).alias("acc"))


@query("T07_levenshtein")  # SQL's distance counts other characters than code points; tests hold it against brute force
def t07(spark, d):
    return turns(spark, d).select("conv_id", "turn", r6(X.closeness(F.col("q"), F.col("r"))).alias("near"))


@query("T08_rouge")
def t08(spark, d):
    return turns(spark, d).select("conv_id", "turn", r6(X.rouge_udf("q", "r")).alias("rouge"))


@query("T10_motion_sentence", "SELECT event_id AS id, printf('motion (speed: %.3f units/s, accel: %+.3f units/s²)', value / 7.3, (value - 50) / 7.3) AS s FROM events")
def t10(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.format_string("motion (speed: %.3f units/s, accel: %+.3f units/s²)", F.col("value") / 7.3, (F.col("value") - 50) / 7.3).alias("s"))


@query("T11_motion_tag", "SELECT event_id AS id, '<motion obj=\"u' || user_id || '\" dir=\"E\" speed=\"slow\" scale=\"stable\"' || CASE WHEN event_id % 3 = 0 THEN ' shape=\"curved\"' ELSE '' END || CASE WHEN event_id % 2 = 0 THEN ' phase=\"reversing\"' ELSE '' END || '/>' AS tag FROM events")
def t11(spark, d):
    e = F.col("event_id")
    parts = {"dir": F.lit("E"), "speed": F.lit("slow"), "scale": F.lit("stable"), "shape": F.when(e % 3 == 0, "curved").otherwise("linear"), "phase": F.when(e % 2 == 0, "reversing").otherwise("constant")}
    return table(spark, d, "events").select(e.alias("id"), X.motion_tag(F.concat(F.lit("u"), S("user_id")), parts).alias("tag"))


@query("T12_insert_tag", f"WITH {TXT} SELECT id, CASE WHEN id % 7 = 0 THEN s ELSE regexp_replace(s, '</t>s', '</t>s<m/>') END AS s FROM x")
def t12(spark, d):
    name = F.concat(F.lit("User "), S("user_id"), F.lit("!"))
    return answers(spark, d).select("id", X.insert_after_last_mention(F.col("s"), name, F.lit("<m/>")).alias("s"))


@query("T13_box_rewrite")
def t13(spark, d):
    return answers(spark, d).select("id", X.rescale_boxes_udf("s", F.lit(0.5)).alias("s"))


@query("T14_clock_seconds", "SELECT event_id AS id, (event_id % 50) * 60.0 + event_id % 60 AS s FROM events")
def t14(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select(e.alias("id"), X.clock_seconds(F.format_string("%02d:%02d", (e % 50).cast("int"), (e % 60).cast("int"))).alias("s"))


@query("T15_subset_name", "SELECT doc_id, regexp_extract('dev_' || lang || '_' || source || '_' || doc_id, '^dev_(.+?)_\\d+$', 1) AS subset FROM documents")
def t15(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_extract(F.concat_ws("_", F.lit("dev"), "lang", "source", S("doc_id")), "^dev_(.+?)_\\d+$", 1).alias("subset"))


@query("T16_safe_name", "SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), 1, 50) AS name FROM pages")
def t16(spark, d):
    return table(spark, d, "pages").select("page_id", X.safe_name(F.col("url")).alias("name"))


@query("T17_remove_tags", f"WITH {TXT} SELECT id, regexp_replace(s, '<motion [^>]*/>', '', 'g') AS s FROM x")
def t17(spark, d):
    return answers(spark, d).select("id", F.regexp_replace("s", "<motion [^>]*/>", "").alias("s"))


@query("R01_P21_blocks", f"WITH {TXT} SELECT id, CASE WHEN s LIKE '%<answer>%' THEN trim(regexp_extract(s, '<answer>(.*?)</answer>', 1)) END AS answer, length(trim(regexp_extract(s, '<think>(.*?)</think>', 1))) AS n FROM x")
def r01(spark, d):
    return answers(spark, d).select("id", P.block(F.col("s"), "answer").alias("answer"), F.length(P.block(F.col("s"), "think")).cast("bigint").alias("n"))


@query("R02_claims", "SELECT event_id AS id, 'User ' || user_id || '!' AS name, event_id % 60 + 0.5 AS t, floor(value) AS x1 FROM events WHERE event_id % 5 > 0 AND event_id % 7 > 0")
def r02(spark, d):
    df = answers(spark, d).select("id", F.explode(P.claims(F.col("s"))).alias("c"))
    return df.select("id", "c.name", "c.t", F.get(F.get("c.boxes", F.lit(0)), F.lit(0)).alias("x1"))


@query("R03_R04_motion_tags", "SELECT event_id AS id, 'user ' || (user_id % 4) AS obj, ['E','NE','UP','STAT'][event_id % 4 + 1] AS dir, ['slow','fast','warp'][event_id % 3 + 1] AS speed, ['stable','approaching'][event_id % 2 + 1] AS scale FROM events")
def r03(spark, d):
    return answers(spark, d).select("id", F.inline(P.motion_tags(F.col("s"))))


@query("R05_compass_word", "SELECT event_id AS id, ['N','E','STAT','NW'][event_id % 4 + 1] AS dir FROM events")
def r05(spark, d):
    return answers(spark, d).select("id", P.compass_word(F.col("s")).alias("dir"))


@query("R06_direction_word", "SELECT event_id AS id, ['up','right','stationary','up-left'][event_id % 4 + 1] AS dir FROM events")
def r06(spark, d):
    return answers(spark, d).select("id", P.direction_word(F.regexp_extract("s", "<motion>(.*?)</motion>", 1)).alias("dir"))


@query("R07_valid_tags", "SELECT event_id AS id, CAST(event_id % 4 <> 2 AND event_id % 3 <> 2 AS INTEGER) AS n FROM events")
def r07(spark, d):
    return answers(spark, d).select("id", P.valid_tags(F.col("s")).alias("n"))


@query("R08_boxes", "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN '320,144,640,360' WHEN 1 THEN '1,2,30,40' ELSE '5,6,70,80' END AS box FROM events")
def r08(spark, d):
    e = F.col("event_id")
    s = F.when(e % 3 == 0, "x <bbox>[0.25, 0.2, 0.5, 0.5]</bbox> [1,1,2,2]").when(e % 3 == 1, "<|box_start|>(1,2),(30,40)<|box_end|>").otherwise("plain [9,9,1,1] [5, 6, 70, 80]")
    df = table(spark, d, "events").select(e.alias("id"), P.boxes(s).alias("b"))
    return df.select("id", F.array_join(F.transform(F.get("b", F.lit(0)), lambda v: v.cast("string")), ",").alias("box"))


@query("R09_interval", "SELECT event_id AS id, event_id % 50 + 0.5 AS a, event_id % 50 + 2.0 AS b FROM events")
def r09(spark, d):
    e = F.col("event_id")
    a, b = F.concat((e % 50).cast("string"), F.lit(".5")), (e % 50 + 2).cast("string")
    s = F.when(e % 3 == 0, F.concat(F.lit("at ["), a, F.lit("s–"), b, F.lit("s] ok"))).when(e % 3 == 1, F.concat(F.lit("("), a, F.lit("s, "), b, F.lit("s)"))).otherwise(F.concat(F.lit("from "), a, F.lit("s To "), b, F.lit("s")))
    iv = P.interval(s)
    return table(spark, d, "events").select(e.alias("id"), iv["start"].alias("a"), iv["end"].alias("b"))


@query("R10_motion_facts", "SELECT event_id AS id, CAST(event_id % 300 AS INTEGER) AS x0, 180.0 AS velocity, 'north-east' AS direction FROM events")
def r10(spark, d):
    s = F.concat(F.lit("Centroid shifts from ("), (F.col("event_id") % 300).cast("string"), F.lit(", 320) to (180,120); velocity: 180 px/s, direction: north-east"))
    f = P.motion_facts(s)
    return table(spark, d, "events").select(F.col("event_id").alias("id"), f["x0"].alias("x0"), f["velocity"].alias("velocity"), f["direction"].alias("direction"))


def _choices(spark, d):
    """Free answers in every form that the parsers know, and in some that they don't."""
    letter = F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (F.col("event_id") % 4 + 1).cast("int"))
    shapes = ["Answer: {}.", "I pick ({}) now", "**{}**", "{}", "A. no, B: no, {} yes", "maybe {} or not", "it must be that which shows a tall tree here", "none of them, nothing to see at all", "", "API Error", "(A) at first, then ({})"]
    text = F.element_at(F.array(*[F.replace(F.lit(x), F.lit("{}"), letter) for x in shapes]), (F.col("event_id") % len(shapes) + 1).cast("int"))
    options = F.array(F.lit("a red cup"), F.lit("a blue plate"), F.lit("a tall tree"), F.lit("a dog"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), text.alias("s"), options.alias("options"))


@query("R17_R30_choose_option")
def r17(spark, d):
    return _choices(spark, d).select("id", P.choose_udf("s", "options").alias("choice"))


@query("R18_choose_staged")
def r18(spark, d):
    return _choices(spark, d).select("id", P.choose_staged_udf("s", "options").alias("choice"))


@query("R19_choose_or_first")
def r19(spark, d):
    return _choices(spark, d).select("id", P.choose_or_first_udf("s", "options").alias("choice"))


@query("R25_judged")
def r25(spark, d):
    chosen = P.judge_choice(P.choose_udf("s", "options"), F.array(F.lit("A"), F.lit("C")))
    said = F.concat(F.lit("We add. So the total is "), (F.col("id") % 5).cast("string"), F.lit(" cups"))
    return _choices(spark, d).select("id", chosen.alias("chosen"), P.judge_open_udf(said, F.array(F.lit("3"), F.lit("4 cups"))).alias("open"))


@query("R20_R28_option_letter", "SELECT event_id AS id, ['A','B','C','D'][event_id % 4 + 1] AS letter FROM events WHERE event_id % 11 > 0")
def r20(spark, d):
    return answers(spark, d).filter("id % 11 > 0").select("id", P.option_letter(P.block(F.col("s"), "answer")).alias("letter"))


@query("R21_gold_index", "SELECT l_orderkey AS ok, l_linenumber AS n, CAST(coalesce(list_position(['a','n','r'], lower(trim(l_returnflag))), 0) - 1 AS INTEGER) AS idx FROM lineitem")
def r21(spark, d):
    options = F.array(F.lit("a"), F.lit("n"), F.lit("r"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("n"), (F.array_position(options, F.lower(F.trim("l_returnflag"))) - 1).cast("int").alias("idx"))


@query("R22_open_answers")
def r22(spark, d):
    s = F.concat(F.lit("We add. So the total is "), F.floor("value").cast("string"), F.lit(" cups"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.array_join(P.open_answers_udf(s), "|").alias("answers"))


@query("R23_numbers", "SELECT event_id AS id, '1,200|3e5|200|5|' || CAST(floor(value) AS INTEGER) || '.5' AS numbers FROM events")
def r23(spark, d):
    s = F.concat(F.lit("from 1,200 to 3e5 and "), F.floor("value").cast("int").cast("string"), F.lit(".5"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.array_join(P.numbers(s), "|").alias("numbers"))


CUT = "Boxes: {\"1\": [1, 2, 3, D], 'b': [5, 6, 7, D]}, so"


@query("R26_repaired_boxes", "SELECT event_id AS id, CASE WHEN event_id % 60 >= 24 THEN event_id % 10 END::DOUBLE AS one, CASE WHEN event_id % 60 >= 43 THEN event_id % 10 END::DOUBLE AS two FROM events")
def r26(spark, d):
    # A text of two boxes that breaks off anywhere; the last number of each stands at its 24th and 43rd character.
    e = F.col("event_id")
    s = F.substring(F.replace(F.lit(CUT), F.lit("D"), (e % 10).cast("string")), F.lit(1), (e % 60).cast("int"))
    found = table(spark, d, "events").select(e.alias("id"), P.repaired_boxes_udf(s).alias("b"))
    return found.select("id", F.get(F.try_element_at("b", F.lit("1")), F.lit(3)).alias("one"), F.get(F.try_element_at("b", F.lit("b")), F.lit(3)).alias("two"))


@query("R29_option_map", "SELECT c_custkey AS k, 'B' AS letter, c_mktsegment AS option FROM customer")
def r29(spark, d):
    options = F.array("c_name", "c_mktsegment")
    letters = F.transform(options, lambda o, i: F.char(65 + i))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("B").alias("letter"), F.element_at(F.map_from_arrays(letters, options), "B").alias("option"))


@query("P01_P02_eligible", "SELECT event_id AS id FROM events WHERE event_type IN ('click', 'purchase') AND length(props) > 0")
def p01(spark, d):
    return table(spark, d, "events").filter(F.col("event_type").isin("click", "purchase") & (F.length("props") > 0)).select(F.col("event_id").alias("id"))


@query("P05_P09_P10_P11_filters", "SELECT doc_id FROM documents WHERE source = 'src1' AND trim(lang) = 'en' AND NOT contains(text, 'API Error')")
def p05(spark, d):
    return table(spark, d, "documents").filter((F.col("source") == "src1") & (F.trim("lang") == "en") & ~F.col("text").contains("API Error")).select("doc_id")


@query("P06_typed_elements", "SELECT p_partkey AS k, CAST(CASE WHEN trim(p_brand) <> '' THEN 2 ELSE 1 END AS INTEGER) AS n FROM part")
def p06(spark, d):
    kf = F.array(*[F.struct(t.alias("time"), p.alias("path")) for t, p in ((F.lit(1.0), F.col("p_brand")), (F.lit(None).cast("double"), F.col("p_name")), (F.lit(2.0), F.lit("x.jpg")))])
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.size(F.filter(kf, lambda x: x["time"].isNotNull() & (F.trim(x["path"]) != ""))).alias("n"))


@query("P07_P12_valid", "SELECT l_returnflag AS rf, round(avg(l_quantity) FILTER (l_linenumber >= 2), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def p07(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("rf")).agg(r6(F.avg(F.when(F.col("l_linenumber") >= 2, F.col("l_quantity")))).alias("mean"))


ALIASES = {"ENGLISH": "en", "CAR": "AUTOMOBILE"}


@query("P08_category_resolution", "WITH c AS (SELECT c_mktsegment AS category, min(c_custkey) AS place FROM customer GROUP BY 1), r AS (SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'cAr' WHEN 2 THEN lower(substr(c_mktsegment, 2, 3)) WHEN 3 THEN 'none' WHEN 4 THEN 'E' ELSE '' END AS name FROM customer) SELECT k, coalesce((SELECT category FROM c WHERE category = name), CASE upper(name) WHEN 'CAR' THEN 'AUTOMOBILE' WHEN 'ENGLISH' THEN 'en' END, (SELECT min_by(category, place) FROM c WHERE contains(lower(category), lower(name))), name) AS category FROM r")
def p08(spark, d):
    c = table(spark, d, "customer")
    known = c.groupBy(F.col("c_mktsegment").alias("category")).agg(F.min("c_custkey").alias("place"))
    k = F.col("c_custkey") % 6
    name = F.when(k == 0, F.col("c_mktsegment")).when(k == 1, "cAr").when(k == 2, F.lower(F.substring("c_mktsegment", 2, 3))).when(k == 3, "none").when(k == 4, "E").otherwise("")
    asked = c.select(F.col("c_custkey").alias("k"), name.alias("name"))
    return B.resolved(asked, "name", known, ALIASES).select("k", "category")


@query("P15_P16_P19_frame_prompt", "SELECT p_partkey AS k, array_to_string(list_transform(range(0, p_size % 4 + 1), lambda i: printf('Frame %d at t=%.2fs', i + 1, i * 2.0)), chr(10)) AS prompt FROM part")
def p15(spark, d):
    frames = F.transform(F.sequence(F.lit(0), F.col("p_size") % 4), lambda i: F.format_string("Frame %d at t=%.2fs", i + 1, i * F.lit(2.0)))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.array_join(frames, "\n").alias("prompt"))


@query("P17_P23_options", "SELECT c_custkey AS k, '(A) ' || c_name || chr(10) || '(B) ' || c_mktsegment AS prompt FROM customer")
def p17(spark, d):
    lines = F.transform(F.array("c_name", "c_mktsegment"), lambda o, i: F.concat(F.lit("("), F.char(65 + i), F.lit(") "), o))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.array_join(lines, "\n").alias("prompt"))


@query("P18_split_options", "SELECT c_custkey AS k, 'B. ' || c_mktsegment AS options, 'Which?' AS question FROM customer")
def p18(spark, d):
    lines = F.split(F.concat(F.lit("Which?\nB. "), "c_mktsegment"), "\n")
    option = lambda x: x.rlike("^[A-Z]\\.\\s*")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.array_join(F.filter(lines, option), "|").alias("options"), F.array_join(F.filter(lines, lambda x: ~option(x)), "|").alias("question"))


@query("P20_strip_nulls", "SELECT l_orderkey AS ok, l_linenumber AS n, CAST(CASE WHEN l_quantity > 25 THEN 2 ELSE 1 END AS INTEGER) AS size FROM lineitem")
def p20(spark, d):
    m = F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.when(F.col("l_quantity") > 25, F.col("l_quantity")))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("n"), F.size(F.map_filter(m, lambda k, v: v.isNotNull())).alias("size"))


@query("P22_whole_seconds", "SELECT event_id AS id, CAST(s AS BIGINT) AS s FROM events, unnest(range(CAST(ceil(value / 10) AS BIGINT), CAST(floor(value / 8) AS BIGINT) + 1)) t(s)")
def p22(spark, d):
    a, b = F.ceil(F.col("value") / 10), F.floor(F.col("value") / 8)
    # A range that runs backwards is empty, where sequence() would count down.
    whole = F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.explode(whole).alias("s"))


@query("P25_question_text", "SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE lang || ' / ' || source END AS q FROM documents")
def p25(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(F.concat_ws(" / ", F.nullif(F.when(F.col("lang") == "en", "").otherwise(F.col("lang")), F.lit("")), F.nullif("source", F.lit(""))), F.lit("")), F.lit("no question")).alias("q"))


@query("P28_first_moving", f"WITH {TXT} SELECT min(id) AS id FROM x WHERE s NOT LIKE '%dir=\"STAT\"%'")
def p28(spark, d):
    return answers(spark, d).filter(F.exists(P.motion_tags(F.col("s")), lambda t: t["dir"] != "STAT")).orderBy("id").limit(1).select("id")


@query("P29_P30_media", "SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id")
def p29(spark, d):
    content = F.array(F.struct(F.when(F.col("role") == "user", "video").otherwise("text").alias("type")), F.struct(F.lit("text").alias("type")))
    df = table(spark, d, "conversations").select("conv_id", F.explode(content).alias("c")).filter(F.col("c.type").isin("image", "video"))
    return df.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


@query("P31_pixel_budget", "SELECT p_partkey AS k, CAST(greatest(least(100352, 90316800 * 2 / (p_size + 1)), trunc(100352 * 1.05)) AS BIGINT) AS pixels, CAST(p_size + p_size % 2 AS INTEGER) AS frames FROM part")
def p31(spark, d):
    n = F.col("p_size") + 1
    pixels = F.greatest(F.least(F.lit(100352.0), F.lit(90316800.0) * 2 / n), F.lit(float(int(100352 * 1.05))))
    frames = F.sequence(F.lit(1), F.col("p_size"))
    padded = F.when(F.col("p_size") % 2 == 1, F.concat(frames, F.array(F.element_at(frames, -1)))).otherwise(frames)
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), pixels.cast("bigint").alias("pixels"), F.size(padded).alias("frames"))
