"""A corpus pipeline over `documents`: quality rules, near-dedup, decontamination, secret scans, mixing.

Each stage works on all that the one before kept, which is written and read again; a stage's result must be written before
the next stage is called, which deletes the tables that the former one left in the shared folder. Defined results: null and empty texts
fail the quality rules and go; rows equal in id and text, and copies under other ids, are one document after the
near-dedup, that of the smallest id (ties: the smallest hash of the text); a null source is a host and a source of its
own; very long texts go through whole; all columns of the input stay in every stage, but the last replaces any that have
the names of its own (size, source_size, target, taken); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinespark.llm import decontaminate, mixing, quality, secrets, simhash
from kinespark.llm.common import cut, stage, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stage(lambda: quality.clean(docs), docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stage(lambda: simhash.dedup(docs), docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stage(lambda: decontaminate.clean(docs, table(spark, sf_dir, "benchmark")), docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stage(lambda: secrets.redact(docs), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stage(lambda: mixing.blend(docs), docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_quality),
    ("near-dedup", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("secret scans", without_secrets),
    ("mixing", mixed),
]

#: SQL can't express the near-dedup's components and the alignments; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
