"""Source and sink queries (S and K of the survey). What is written goes to the folder that executors share."""

from pyspark.sql import functions as F

from kinespark.operators import benchmarks as B
from kinespark.sources import readers as R
from kinespark.sources.shared import shared_path
from kinespark.sources.tables import table

from .registry import query


def scratch(spark, name):
    return f"{shared_path(spark, 'scan')}/{name}"


SMALL = "SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer"
SCHEMA = "k bigint, name string, bal double"


def customers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))


def _through(ending):
    def run(spark, d):
        path = scratch(spark, f"customers.{ending}")
        R.dump(customers(spark, d), path)
        return R.load(spark, path, SCHEMA)

    return run


for _name, _ending in (("S03_K02_jsonl_round_trip", "jsonl"), ("S04_S05_parquet_round_trip", "parquet"), ("S07_tsv_round_trip", "tsv"), ("S10_csv_round_trip", "csv"), ("S10_orc_round_trip", "orc")):
    query(_name, SMALL)(_through(_ending))


@query("S06_S09_U02_partitions_as_one", "SELECT 'even' AS part, c_custkey AS k FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'odd', c_custkey FROM customer WHERE c_custkey % 2 = 1")
def s06(spark, d):
    paths = {}
    for name, rest in (("even", 0), ("odd", 1)):
        paths[name] = scratch(spark, f"{name}.parquet")
        R.dump(customers(spark, d).filter(F.col("k") % 2 == rest), paths[name])
    return R.union_of(spark, paths, SCHEMA, "part").select("part", "k")


S08 = """WITH q AS (SELECT conv_id, turn, role, CASE turn % 4 WHEN 0 THEN 'NA' WHEN 1 THEN ' b ' WHEN 2 THEN '' ELSE 'nA' || turn END AS answer, CASE WHEN turn % 5 > 0 THEN printf('What of %d?\n A. this\nB.that %d\nand more', conv_id, turn) ELSE '' END AS question FROM conversations)
SELECT conv_id AS key, CAST(turn AS VARCHAR) AS uid, CASE WHEN conv_id % 4 = 3 THEN 'v' || conv_id ELSE conv_id || '.mp4' END AS video, printf('What of %d?\nand more', conv_id) AS question, 'A:this|B:that ' || turn AS options, upper(trim(answer)) AS answer FROM q WHERE conv_id % 3 <> 1 AND question <> '' AND answer <> '' AND upper(answer) <> 'NA'"""


@query("S08_nested_records", S08)
def s08(spark, d):
    path = scratch(spark, "meta.jsonl")
    t, k = F.col("turn"), F.col("conv_id")
    answer = F.when(t % 4 == 0, "NA").when(t % 4 == 1, " b ").when(t % 4 == 2, "").otherwise(F.concat(F.lit("nA"), t.cast("string")))
    question = F.when(t % 5 > 0, F.format_string("What of %d?\n A. this\nB.that %d\nand more", k, t)).otherwise("")
    qa = F.collect_list(F.struct(t.cast("string").alias("uid"), answer.alias("answer"), question.alias("question")))
    kinds = F.when(k % 3 == 0, "MR").when(k % 3 == 1, "AO").otherwise("RC")
    # A conversation has few turns.
    R.dump(table(spark, d, "conversations").groupBy(k.cast("string").alias("key"), kinds.alias("question_type"), F.when(k % 4 == 3, F.concat(F.lit("v"), k.cast("string"))).alias("video_path")).agg(qa.alias("qa")), path)
    df = R.load(spark, path, "key string, question_type string, video_path string, qa array<struct<uid: string, answer: string, question: string>>")
    df = B.questions(df, ["MR", "RC"])
    options = F.array_join(F.transform("options", lambda o: F.concat(o["letter"], F.lit(":"), o["text"])), "|")
    return df.select(F.col("key").cast("bigint").alias("key"), "uid", "video", "question", options.alias("options"), "answer")


@query("S12_subtitles", "SELECT page_id AS id, page_id % 60 + 0.5 AS start, page_id % 60 + 62.0 AS \"end\", 'hello ' || page_id || ' there' AS text FROM pages")
def s12(spark, d):
    sec = F.lpad((F.col("page_id") % 60).cast("string"), 2, "0")
    srt = F.concat(F.lit("1\n00:00:"), sec, F.lit(",500 --> 00:01:"), F.lpad((F.col("page_id") % 60 + 2).cast("string"), 2, "0"), F.lit(",000\nhello "), F.col("page_id").cast("string"), F.lit("\nthere\n\nbad\n"))
    cues = R.subtitles(table(spark, d, "pages").select(srt.alias("value")))
    return cues.select(F.regexp_extract("text", "(\\d+)", 1).cast("bigint").alias("id"), "start", "end", "text")


@query("S13_sidecar_text", "SELECT d.doc_id, coalesce(b.text, 'No transcript.') AS transcript FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def s13(spark, d):
    side = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return table(spark, d, "documents").select("doc_id").join(side, "doc_id", "left").select("doc_id", F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("No transcript.")).alias("transcript"))


@query("K08_census", "SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM documents GROUP BY lang")
def s17(spark, d):
    docs = table(spark, d, "documents")
    total = docs.agg(F.count(F.lit(1)).alias("total"), F.lit(1).alias("one"))
    by = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    return by.join(total, "one").select("lang", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"))


@query("S20_routing", "SELECT doc_id, CASE source WHEN 'src1' THEN '/first' WHEN 'src2' THEN '/second' ELSE '/rest' END || '/' || lang AS root FROM documents")
def s20(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat_ws("/", R.route(F.col("source"), {"src1": "/first", "src2": "/second"}, {"src": "/rest"}), "lang").alias("root"))


@query("K03_metrics", "SELECT l_returnflag AS rf, round(avg(l_discount), 6) AS score, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def k03(spark, d):
    path = scratch(spark, "metrics.json")
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("rf")).agg(F.round(F.avg("l_discount"), 6).alias("score"), F.count(F.lit(1)).alias("n"))
    R.dump(m, path, "jsonl")
    return R.load(spark, path, "rf string, score double, n bigint", "jsonl")


@query("K06_correct_only", "SELECT doc_id FROM labels WHERE quality = toxic")
def k06(spark, d):
    path = scratch(spark, "correct")
    table(spark, d, "labels").filter(F.col("quality") == F.col("toxic")).write.partitionBy("quality").parquet(path)
    return spark.read.parquet(path).select("doc_id")
