"""Messages, prompts, routing, checklists and shown steps (P13, P14, P24, P26, S21, R27, R31 of the survey)."""

from pyspark.sql import functions as F

from kinespark.functions import prompts as M
from kinespark.sources.tables import table

from .registry import query

SYSTEMS = {t: f"Solve this {t}." for t in M.ALL_TASKS}
ROOTS = {t: f"/data/{k}" + "/" * (k % 2) for k, t in enumerate(M.TASKS)}
CASE = lambda values, key: f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"
TURNS = f"c AS (SELECT *, {CASE(M.TASKS, 'conv_id % 5')} AS task, {CASE([ROOTS[t].rstrip('/') for t in M.TASKS], 'conv_id % 5')} AS root FROM conversations)"


def _turns(spark, d):
    k = (F.col("conv_id") % 5).cast("int")
    return table(spark, d, "conversations").withColumn("task", F.element_at(F.array(*map(F.lit, M.TASKS)), k + 1))


@query("P13_conversation", f"WITH {TURNS} SELECT conv_id, turn, 'Solve this ' || task || '.' AS system, CASE WHEN conv_id % 5 = 0 THEN 'image' ELSE 'video' END AS medium, text AS asked FROM c")
def p13(spark, d):
    m = M.conversation(F.col("task"), F.col("text"), SYSTEMS)
    df = _turns(spark, d).select("conv_id", "turn", m.alias("m"))
    at = lambda k, i: F.get(F.get("m", F.lit(k))["content"], F.lit(i))
    return df.select("conv_id", "turn", at(0, 0)["value"].alias("system"), at(1, 0)["type"].alias("medium"), at(1, 1)["value"].alias("asked"))


@query("P14_training_messages", f"WITH {TURNS} SELECT conv_id, turn, 'Solve this ' || task || '.' AS system, CASE WHEN conv_id % 5 = 1 AND turn % 3 = 0 THEN '/plm' ELSE root END || '/v' || conv_id || '.mp4' AS path, CASE WHEN conv_id % 5 > 1 THEN 'Question: ' ELSE '' END || text AS asked, '<think>turn ' || turn || '</think>' || chr(10) || '<answer>' || role || '</answer>' AS said FROM c")
def p14(spark, d):
    source = F.when(F.col("turn") % 3 == 0, "plm").otherwise("other")
    path = F.concat(F.lit("v"), F.col("conv_id").cast("string"), F.lit(".mp4"))
    m = M.training_messages(F.col("task"), source, path, F.col("text"), F.concat(F.lit("turn "), F.col("turn").cast("string")), F.col("role"), SYSTEMS, ROOTS, {"plm": "/plm"})
    df = _turns(spark, d).select("conv_id", "turn", m.alias("m"))
    at = lambda k, i: F.get(F.get("m", F.lit(k))["content"], F.lit(i))["value"]
    return df.select("conv_id", "turn", at(0, 0).alias("system"), at(1, 0).alias("path"), at(1, 1).alias("asked"), at(2, 0).alias("said"))


@query("P24_categorised_question", "SELECT c_custkey AS k, c_name || chr(10) || 'A. ' || c_mktsegment || chr(10) || 'B. none' || chr(10) || 'Category: ' || CASE c_custkey % 3 WHEN 0 THEN 'Seen' WHEN 1 THEN 'Learned' ELSE 'Other' END || CASE c_custkey % 3 WHEN 0 THEN chr(10) || 'Ignore the quiz.' WHEN 1 THEN chr(10) || 'Apply it.' ELSE '' END || chr(10) || 'Think.' AS prompt FROM customer")
def p24(spark, d):
    k = F.col("c_custkey") % 3
    category = F.when(k == 0, "Seen").when(k == 1, "Learned").otherwise("Other")
    prompt = M.categorised(F.col("c_name"), F.array(F.col("c_mktsegment"), F.lit("none")), category, "Category: ", {"Seen": "Ignore the quiz.", "Learned": "Apply it."}, "Think.")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), prompt.alias("prompt"))


#: One template for each question that is asked of an item.
TEMPLATES = {
    "vqa": "Answer: {question}",
    "temporal": "A video of {length} seconds. When: {question}",
    "temporal_2": "A video of {length} seconds at {size}, with {boxes} boxes. When: {question}",
    "spatial": 'Where: {question} At {seconds}, as {"{first}": box}',
    "spatial_2": "Where: {question} In {boxes} boxes.",
}


@query("P26_grounded_prompts", "WITH i AS (SELECT p_partkey AS k, p_name AS q, round(p_size * 37 / 30.0, 2) AS length, p_size % 7 AS n, p_retailprice % 10 AS a, p_retailprice % 10 + p_size % 4 AS b FROM part), j AS (SELECT *, CASE WHEN ceil(a) <= floor(b) THEN range(ceil(a)::BIGINT, floor(b)::BIGINT + 1) ELSE [] END AS s FROM i) SELECT k, 'vqa' AS kind, 'Answer: ' || q AS prompt FROM j UNION ALL SELECT k, 'temporal', 'A video of ' || length::VARCHAR || ' seconds. When: ' || q FROM j UNION ALL SELECT k, 'temporal_2', 'A video of ' || length::VARCHAR || ' seconds at 640x360, with ' || n || ' boxes. When: ' || q FROM j UNION ALL SELECT k, 'spatial', 'Where: ' || q || ' At [' || array_to_string(s, ', ') || '], as {\"' || coalesce(s[1]::VARCHAR, '') || '\": box}' FROM j UNION ALL SELECT k, 'spatial_2', 'Where: ' || q || ' In ' || n || ' boxes.' FROM j")
def p26(spark, d):
    a, n = F.col("p_retailprice") % 10, F.col("p_size") % 7
    boxes = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    item = {"timestamps": F.array(a, a + F.col("p_size") % 4), "frame_count": F.col("p_size") * 37, "fps": F.lit(30.0), "width": F.lit(640), "height": F.lit(360), "bboxes": boxes}
    values = M.grounding_values(item) | {"question": F.col("p_name")}
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), M.filled(t, **values).alias("prompt")) for k, t in TEMPLATES.items()])
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.inline(kinds))


SUBJECTS = [(s, d) for d, held in M.DOMAINS.items() for s in held]


@query("S21_subject_routing", f"WITH m(i, s, d) AS (VALUES {', '.join(f'({i}, {chr(39)}{s}{chr(39)}, {chr(39)}{d}{chr(39)})' for i, (s, d) in enumerate(SUBJECTS))}) SELECT doc_id, s AS subject, '/cache/' || d AS folder FROM documents JOIN m ON i = doc_id % {len(SUBJECTS)}")
def s21(spark, d):
    subject = F.element_at(F.array(*[F.lit(s) for s, _ in SUBJECTS]), (F.col("doc_id") % len(SUBJECTS)).cast("int") + 1)
    return table(spark, d, "documents").select("doc_id", subject.alias("subject"), F.concat(F.lit("/cache/"), M.domain(subject)).alias("folder"))


PARTS = ["<think>so</think>", "<answer>A</answer>", "<obj>cup</obj>", "<box>[1,2]</box>", "at<t>1.5</t>s", '<motion obj="cup" dir="E"/>', "<motion>rightward</motion>"]


@query("R31_P03_checklist", "SELECT event_id AS id, " + ", ".join(f"(event_id >> {k}) & 1 = 1 AS {n}" for k, n in enumerate(("think", "answer", "obj", "box", "time", "tag", "sentence"))) + ", event_id & 28 = 28 AS grounded, event_id & 96 > 0 AS motion FROM events")
def r31(spark, d):
    # Every subset of the parts by the bits of the id, and near misses of them besides.
    bits = [F.when(F.shiftright("event_id", k).bitwiseAND(F.lit(1)) == 1, p) for k, p in enumerate(PARTS)]
    text = F.concat_ws(" ", *bits, F.lit("<t>soon</t>s </obj> <motion"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.inline(F.array(M.checklist(text))))


@query("R27_shown_steps", "WITH e AS (SELECT event_id AS id, event_id % 4 AS f, floor(value)::INTEGER AS v FROM events) SELECT id, 0 AS i, 'word' AS kind, 'look' AS text, NULL::DOUBLE AS side, NULL::DOUBLE AS time FROM e UNION ALL SELECT id, 1, CASE f WHEN 0 THEN 'sighting' WHEN 1 THEN 'move' WHEN 2 THEN 'moment' ELSE 'word' END, CASE f WHEN 0 THEN '<obj>a cup</obj><box>[1,2,3,' || v || ']</box>at<t>2.5</t>s' WHEN 1 THEN '[cup: E slow stable]' WHEN 2 THEN '<t>' || v || '</t>' ELSE '<obj>cup</obj><box>[1,oops]</box>at<t>2</t>s' END, CASE f WHEN 0 THEN v END, CASE f WHEN 0 THEN 2.5 WHEN 2 THEN v END FROM e UNION ALL SELECT id, 2, 'word', 'then', NULL, NULL FROM e UNION ALL SELECT id, 3, 'word', 'stop', NULL, NULL FROM e")
def r27(spark, d):
    f, v = F.col("event_id") % 4, F.floor("value").cast("int").cast("string")
    tag = F.when(f == 0, F.concat(F.lit("<obj>a cup</obj><box>[1,2,3,"), v, F.lit("]</box>at<t>2.5</t>s"))).when(f == 1, '<motion obj="cup" dir="E" speed="slow" scale="stable"/>').when(f == 2, F.concat(F.lit("<t>"), v, F.lit("</t>"))).otherwise("<obj>cup</obj><box>[1,oops]</box>at<t>2</t>s")
    df = table(spark, d, "events").select(F.col("event_id").alias("id"), F.posexplode(M.shown_steps(F.concat(F.lit("look "), tag, F.lit("\n then  stop ")))).alias("i", "s"))
    return df.select("id", "i", "s.kind", "s.text", F.get("s.box", F.lit(3)).alias("side"), "s.time")
