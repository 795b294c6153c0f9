"""Row numbers and contiguous chunks of a distributed order, without a window over the whole table.

Rows are ranged by their sort key, sorted within each partition and written once with their place there. The partitions'
counts (one row each) are summed in order, and a row's number is its partition's start plus its place. Only that table of
counts meets in one task, so what is planned there grows with the number of partitions and not with the rows.

Defined results: equal keys are numbered in some order of theirs, so a caller that needs one gives a complete key; nulls
stand where the key's own order puts them; an empty table has no rows. Equal keys lie in one partition, sorted as a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.sources.shared import written


def _in_range(k: Column) -> Column:
    return F.shiftright(k, 33)


def numbered(df: DataFrame, order: list[Column], name: str = "number", partitions: int | None = None, write: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """df with `name`: 1, 2, 3, ... in the given order, or in the order in which it is read if none is given.

    `write` stores a frame and reads it back; the order in which Spark reads splits is settled there, once.
    """
    if order:
        parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The upper bits of this id are the partition, the lower 33 the row's place in it.
    held = write(df.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    counts = held.groupBy(_in_range(F.col("_place")).alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_one").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_one", F.lit(1)).withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    out = held.withColumn("_part", _in_range(F.col("_place"))).join(F.broadcast(starts.select("_part", "_start")), "_part")
    number = F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return out.withColumn(name, number).drop("_part", "_place", "_start")


def chunked(held: DataFrame, chunks: int, rule: str = "remainder", name: str = "chunk", number: str = "number") -> DataFrame:
    """A frame of `numbered` with `name`, the contiguous chunk (from 0) of each row.

    rule "remainder": sizes differ by at most one, and the first rows % chunks chunks are the larger ones; "ceil": all
    chunks have ceil(rows / chunks) rows but the last, and some may be empty; "floor": all have floor(rows / chunks) but
    the last, which takes the rest.
    """
    if rule not in ("remainder", "ceil", "floor"):
        raise ValueError(f"no rule named {rule}")
    total = held.agg(F.count(F.lit(1)).alias("_total")).withColumn("_one", F.lit(1))
    out = held.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")  # one row
    at, k = F.col(number) - 1, F.lit(chunks).cast("bigint")
    small = F.expr(f"_total div {chunks}")
    if rule == "remainder":
        more = F.col("_total") % k
        edge = more * (small + 1)
        chunk = F.when(at < edge, F.floor(at / (small + 1))).otherwise(more + F.floor((at - edge) / F.greatest(small, F.lit(1))))
    elif rule == "ceil":
        chunk = F.floor(at / F.greatest(F.ceil(F.col("_total") / k), F.lit(1)))
    else:
        chunk = F.least(k - 1, F.floor(at / F.greatest(small, F.lit(1))))
    return out.withColumn(name, chunk.cast("int")).drop("_one", "_total")


def pieces(df: DataFrame, keys: list[str], order: list[Column], size: int, **options) -> DataFrame:
    """df with `piece` (from 0) and `place` in it (from 0): runs of up to `size` rows of each key's rows in order.

    Rows are numbered over all keys at once, so a key with many rows is spread over as many partitions as they fill.
    """
    held = numbered(df, [*[F.col(k) for k in keys], *order], "_number", **options)
    first = held.groupBy(*keys).agg(F.min("_number").alias("_first"))
    same = [F.col(f"h.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    out = held.alias("h").join(first.alias("f"), same).select("h.*", (F.col("_number") - F.col("_first")).alias("_at"))
    return out.withColumns({"piece": F.expr(f"_at div {size}"), "place": (F.col("_at") % size).cast("int")}).drop("_number", "_at")
