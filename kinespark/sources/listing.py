"""Recursive listings of files as rows, without their contents; finds by name and counts by folder.

Spark's listing gives the rows; paths and sizes are all that is read, as the contents' column isn't asked for.

Defined results: names are compared as they are, with case; of files that share a name the first path in order counts; a
folder's count takes in all below it; folders that are asked for and hold no such file, or don't exist, count 0.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, modificationTime timestamp, length long"


def listing(spark: SparkSession, root: str, ending: str = "") -> DataFrame:
    """path, folder, name, length and modificationTime of each file below a folder; none if there is no such folder."""
    try:
        held = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        held = spark.createDataFrame([], SCHEMA)
    name = F.substring_index("path", "/", -1)
    held = held.select("path", F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)").alias("folder"), name.alias("name"), "length", "modificationTime")
    return held.filter(F.col("name").endswith(ending)) if ending else held


def find(listed: DataFrame, wanted: DataFrame, key: str, name: Column) -> DataFrame:
    """wanted with `found`, the path of the first file of the name that a row asks for; null without one."""
    first = listed.groupBy(F.col("name").alias("_name")).agg(F.min("path").alias("found"))
    return wanted.withColumn("_name", name).join(first, "_name", "left").drop("_name")


def _above(folder: Column) -> Column:
    """A folder and all above it."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def census(listed: DataFrame, folders: DataFrame, folder: str = "folder") -> DataFrame:
    """folders with n_files and n_bytes of all files below each, and whether there are any."""
    wanted = folders.withColumn("_folder", F.regexp_replace(F.rtrim(F.col(folder), F.lit("/")), "^file:/+", "/"))
    each = listed.select(F.explode(_above(F.regexp_replace("folder", "^file:/+", "/"))).alias("_folder"), "length")
    counted = each.groupBy("_folder").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))
    out = wanted.join(counted, "_folder", "left").drop("_folder")
    return out.withColumns({"n_files": F.coalesce("n_files", F.lit(0)), "n_bytes": F.coalesce("n_bytes", F.lit(0))}).withColumn("present", F.col("n_files") > 0)


def complete(listed: DataFrame, names: list[str]) -> DataFrame:
    """One row: whether files of all the names are there, and how many are missing."""
    there = F.count_distinct(F.when(F.col("name").isin(*names), F.col("name")))
    return listed.agg((F.lit(len(set(names))) - there).alias("missing")).withColumn("complete", F.col("missing") == 0)
