"""Readers and writers by format. Schemas are given, never inferred from data; rows that don't fit are dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READERS: dict[str, Callable[[SparkSession, str, str], DataFrame]] = {
    "json": lambda s, p, schema: s.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(p),
    "jsonl": lambda s, p, schema: s.read.schema(schema).json(p),
    "parquet": lambda s, p, schema: s.read.schema(schema).parquet(p),
    "csv": lambda s, p, schema: s.read.schema(schema).option("header", True).csv(p),
    "tsv": lambda s, p, schema: s.read.schema(schema).option("header", True).option("sep", "\t").csv(p),
    "orc": lambda s, p, schema: s.read.schema(schema).orc(p),
}
WRITERS: dict[str, Callable[[DataFrame, str], None]] = {
    "json": lambda df, p: df.write.mode("overwrite").json(p),
    "jsonl": lambda df, p: df.write.mode("overwrite").json(p),
    "parquet": lambda df, p: df.write.mode("overwrite").parquet(p),
    "csv": lambda df, p: df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(p),
    "tsv": lambda df, p: df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("sep", "\t").csv(p),
    "orc": lambda df, p: df.write.mode("overwrite").orc(p),
}


def suffix(path: str) -> str:
    """The format that a path's ending names; a path without one is a folder of Parquet."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else "parquet"


def load(spark: SparkSession, path: str, schema: str, fmt: str | None = None) -> DataFrame:
    kind = fmt or suffix(path)
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}")
    return READERS[kind](spark, path, schema)


def dump(df: DataFrame, path: str, fmt: str | None = None) -> None:
    kind = fmt or suffix(path)
    if kind not in WRITERS:
        raise ValueError(f"no writer for {kind}")
    WRITERS[kind](df, path)


def union_of(spark: SparkSession, paths: dict[str, str], schema: str, name: str) -> DataFrame:
    """Several tables as one, with a column that says which."""
    out = None
    for value, path in paths.items():
        part = load(spark, path, schema).withColumn(name, F.lit(value))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def subtitles(df: DataFrame, text: str = "value") -> DataFrame:
    """(start, end, text) for each cue of whole SRT files, one file a row."""
    cue = df.select(F.explode(F.split(F.regexp_replace(text, "\r", ""), "\n\n+")).alias("b"))
    lines = cue.select(F.filter(F.split("b", "\n"), lambda x: F.trim(x) != "").alias("l")).filter(F.size("l") >= 3)
    seconds = lambda k: F.aggregate(F.transform(F.split(F.replace(F.trim(F.get(F.split(F.get("l", F.lit(1)), "-->"), F.lit(k))), F.lit(","), F.lit(".")), ":"), lambda p: p.try_cast("double")), F.lit(0.0), lambda a, p: a * 60 + p)
    return lines.select(seconds(0).alias("start"), seconds(1).alias("end"), F.array_join(F.slice("l", 3, 1000), " ").alias("text"))


def route(column, exact: dict[str, str], within: dict[str, str]):
    """A root by exact name, else by a part of the name; an error for others."""
    out = None
    for k, v in exact.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    for k, v in within.items():
        out = out.when(column.contains(k), v)
    return out.otherwise(F.raise_error(F.concat(F.lit("no root for "), column)).cast("string"))
