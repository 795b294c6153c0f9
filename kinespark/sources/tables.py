"""The test tables as the engine's inputs: object tracks, boxes, intervals and completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {}) / 1000000D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(name: str) -> Column:
    """A timestamp without zone as seconds since 1970, whatever the session's zone."""
    return F.expr(EPOCH.format(f"cast({name} as timestamp_ntz)"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obj, ord, t, x, y, kind and box: each event is a sighting of its user."""
    k = F.get_json_object("props", "$.k").cast("double")
    df = table(spark, sf_dir, "events").select(F.col("user_id").alias("obj"), F.col("event_id").alias("ord"), seconds("ts").alias("t"), F.col("value").alias("x"), k.alias("y"), F.col("event_type").alias("kind"))
    return df.withColumn("box", F.array("x", "y", F.col("x") + 10 + F.col("ord") % 7, F.col("y") + 10 + F.col("ord") % 5))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ok, n and box from the numbers of each order's lines."""
    x, y = F.col("l_discount") * 100, F.col("l_tax") * 100
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("n"), F.array(x, y, x + F.col("l_quantity"), y + F.col("l_linenumber") * 5).alias("box"))


#: The same in DuckDB's SQL.
OBS = """obs AS (SELECT user_id AS obj, event_id AS ord, epoch_us(ts) / 1000000.0 AS t, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, event_type AS kind FROM events),
obox AS (SELECT *, x AS x1, y AS y1, x + 10 + ord % 7 AS x2, y + 10 + ord % 5 AS y2 FROM obs)"""
BOX = "box AS (SELECT l_orderkey AS ok, l_linenumber AS n, l_discount * 100 AS x1, l_tax * 100 AS y1, l_discount * 100 + l_quantity AS x2, l_tax * 100 + l_linenumber * 5 AS y2 FROM lineitem)"
PAIR = BOX + ", pair AS (SELECT a.ok, a.n, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM box a JOIN box b ON a.ok = b.ok AND b.n = a.n + 1)"
