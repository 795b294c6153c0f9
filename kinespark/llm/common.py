"""What the text operators share: words, row keys and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: space and U+0009 to U+000D (fixed value).
SPACE = "[\\x20\\x09-\\x0D]+"
HAS_WORD = "[^\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spaced(text: Column) -> Column:
    """A text, empty if null, with a space for each other white space. Plain replacement costs far less than a pattern."""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\f\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def words(text: Column) -> Column:
    """The words of a text, without empty ones; none for a null text."""
    return F.array_remove(F.split(spaced(text), " "), "")


def row_key(*columns: str) -> Column:
    """A 128-bit key of a row's contents, never null. Null and empty columns differ."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once, here.

    A plain projection may be inlined where its columns are used, also inside lambdas and pushed filters, which
    evaluates them again for each element. The optimizer doesn't look through a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def tuck(df: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, and all others as the one column `_row`: no name of theirs can clash with an operator's own."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in keep]
    return df.select(*[c for c in keep if c in df.columns], *([F.struct(*rest).alias("_row")] if rest else []))


def untuck(df: DataFrame, names: list[str], *keep: str, **new: Column) -> DataFrame:
    """The columns of before tuck(), in their order; those of `new` are replaced."""
    return df.select(*[(new[c] if c in new else F.col(c) if c in keep else F.col("_row")[c]).alias(c) for c in names])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session in one process may name none; it gets one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.conf.get("spark.master", "")
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='kinespark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: What cut() has written, for each scratch() that is open; and for former stages.
_made: list[list[DataFrame]] = []
_left: list[DataFrame] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if _made:
        _made[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete what cut() wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, df._cut_path
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes at its end what cut() wrote within, but for the frames put in the list that it gives."""
    keep: list[DataFrame] = []
    _made.append([])
    try:
        yield keep
    finally:
        made = _made.pop()
        for df in made:
            if not any(df is k for k in keep):
                discard(df)
        if _made:
            _made[-1] += [k for k in keep if any(k is df for df in made)]


def stage(run: Callable[[], DataFrame], docs: DataFrame) -> DataFrame:
    """run(), a stage of a pipeline over docs, which is a table or the former stage's result written and read again.

    First the tables that former stages left are deleted, but for those that docs itself reads.
    """
    read = {f.rsplit("/", 2)[-2] for f in docs.inputFiles()}
    gone = [df for df in _left if df._cut_path.rsplit("/", 1)[-1] not in read]
    _left[:] = [df for df in _left if not any(df is x for x in gone)]
    for df in gone:
        if df.sparkSession is docs.sparkSession:  # another session may have ended
            discard(df)
    _made.append([])
    try:
        return run()
    finally:
        _left.extend(_made.pop())
