"""Nearest, interval and matching joins.

Times that meet within a tolerance are joined by equality of time buckets as wide as the tolerance, each probe looking
in its own bucket and the two beside it, so that no join compares all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinespark.sources.shared import written


def nearest_join(probe: DataFrame, build: DataFrame, keys: list[str], tolerance: float, probe_id: list[str], same: list[str] = ()) -> DataFrame:
    """Each probe row with the build row nearest in time, strictly within the tolerance; the earlier `ord` on ties.

    probe has t and probe_id, build has t and ord; build's columns come with the prefix `near_`. Probes without a match
    are dropped, and so are those of which the nearest row differs in a column of `same`: none falls back to another.
    """
    width = float(tolerance)
    b = build.select(*[F.col(c) if c in keys else F.col(c).alias(f"near_{c}") for c in build.columns])
    b = b.withColumn("_slot", F.floor(F.col("near_t") / width))
    p = probe.withColumn("_slot", F.explode(F.array(*[F.floor(F.col("t") / width) + k for k in (-1, 0, 1)])))
    met = p.join(b, [*keys, "_slot"]).withColumn("_apart", F.abs(F.col("t") - F.col("near_t"))).filter(F.col("_apart") < width)
    near = [c for c in b.columns if c.startswith("near_")]
    best = F.min_by(F.struct(*near), F.struct("_apart", "near_ord"))
    rest = [c for c in probe.columns if c not in probe_id]
    out = met.groupBy(*probe_id).agg(*[F.first(c).alias(c) for c in rest], best.alias("_n"))
    out = out.select(*probe_id, *rest, "_n.*")
    for c in same:
        out = out.filter(F.col(c) == F.col(f"near_{c}"))
    return out


def one_sided_nearest(times: Column, t: Column, tolerance: float = 1.0) -> Column:
    """Of an array of times the nearest to t among those less than `tolerance` after it (any before it qualify)."""
    near = F.filter(times, lambda g: g - t < tolerance)
    best = F.array_min(F.transform(near, lambda g: F.struct(F.abs(g - t).alias("d"), g.alias("g"))))
    return best["g"]


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], t: str, start: str, end: str, bucket: float) -> DataFrame:
    """Each point with the closed intervals of its key that hold it. Intervals are cut into buckets of a fixed width."""
    p = points.withColumn("_slot", F.floor(F.col(t) / bucket))
    s = spans.filter(F.col(start) <= F.col(end)).withColumn("_slot", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    return p.join(s, [*keys, "_slot"]).filter(F.col(t).between(F.col(start), F.col(end))).drop("_slot")


def containing_join(points: DataFrame, spans: DataFrame, keys: list[str], t: str, start: str, end: str, unit: float = 1.0) -> DataFrame:
    """Each point with the closed intervals of its keys (if any) that hold it, whatever the intervals' lengths.

    An interval lies in the grid whose cells are the power of two of `unit` next above its length, where it touches two
    cells at most; a point looks in one cell of each grid that its key has. So an interval makes two rows, a point as many
    as there are powers, up to 64. Empty intervals and nulls hold nothing and are held by none.
    """
    keys, own = (keys, False) if keys else (["_every"], True)
    if own:
        points, spans = points.withColumn("_every", F.lit(0)), spans.withColumn("_every", F.lit(0))
    power = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest((F.col(end) - F.col(start)) / unit, F.lit(1.0))))).cast("int")
    cell = lambda x: F.floor(F.col(x) / (F.lit(unit) * F.pow(F.lit(2.0), F.col("_power"))))
    s = spans.filter(F.col(start) <= F.col(end)).withColumn("_power", power)
    s = s.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(start), cell(end)))))
    grids = s.groupBy(*keys).agg(F.collect_set("_power").alias("_powers"))
    p = points.filter(F.col(t).isNotNull()).join(grids, keys).withColumn("_power", F.explode("_powers")).drop("_powers")
    p = p.withColumn("_cell", cell(t))
    return p.join(s, [*keys, "_power", "_cell"]).filter(F.col(t).between(F.col(start), F.col(end))).drop("_power", "_cell", *(["_every"] if own else []))


def contained_totals(points: DataFrame, spans: DataFrame, keys: list[str], t: str, start: str, end: str, by: list[str], write: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """For each `by` of spans: `inside`, how many points its closed intervals hold, and `offset`, the sum of how far into
    them they lie. Those that hold none are left out.

    No pair of a point and an interval is made. Points are added up by key and time; running sums over them are read at the
    distinct starts and ends, in ranges of keys and times, each from the sum of those before it; and an interval takes the
    difference of two. So the work grows with points and intervals, whatever these hold. Sums are kept in whole
    microseconds, so differences of large ones are exact for times of no finer grain. Times are finite; empty intervals and
    nulls hold nothing and are held by none.
    """
    micros = lambda c: F.round(F.col(c) * 1000000).cast("decimal(38,0)")
    spans = spans.filter(F.col(start) <= F.col(end)).dropna(subset=keys)
    number, total, none = F.count(F.lit(1)).alias("_n"), F.sum(micros("_at")).cast("decimal(38,0)").alias("_t"), F.lit(0).cast("decimal(38,0)")
    held = points.dropna(subset=[*keys, t]).select(*keys, F.col(t).alias("_at")).groupBy(*keys, "_at").agg(number, total).withColumn("_kind", F.lit(1))
    # At one time starts stand before the points and ends after them, as both ends are inside.
    edge = lambda c, kind: spans.select(*keys, F.col(c).alias("_at")).distinct().select(*keys, "_at", F.lit(0).cast("bigint").alias("_n"), none.alias("_t"), F.lit(kind).alias("_kind"))
    every = held.unionByName(edge(start, 0)).unionByName(edge(end, 2))
    order = [*keys, "_at", "_kind"]
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = write(every.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "running")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = every.groupBy(*keys, "_part").agg(F.sum("_n").alias("_n"), F.sum("_t").cast("decimal(38,0)").alias("_t"))
    sums = sums.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_t").over(before).cast("decimal(38,0)"), none).alias("_t0"))
    within = Window.partitionBy(*keys, "_part").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = every.withColumns({"_n": F.sum("_n").over(within), "_t": F.sum("_t").over(within).cast("decimal(38,0)")}).filter("_kind <> 1")
    summed = summed.join(sums, [*keys, "_part"]).select(*keys, "_at", "_kind", (F.col("_n") + F.col("_n0")).alias("_n"), (F.col("_t") + F.col("_t0")).cast("decimal(38,0)").alias("_t"))
    at = lambda kind, c, e: summed.filter(F.col("_kind") == kind).select(*keys, F.col("_at").alias(c), F.col("_n").alias(f"_n{e}"), F.col("_t").alias(f"_t{e}"))
    met = spans.join(at(0, start, "a"), [*keys, start]).join(at(2, end, "b"), [*keys, end]).withColumn("_inside", F.col("_nb") - F.col("_na")).filter("_inside > 0")
    far = (F.col("_tb") - F.col("_ta")).cast("decimal(38,0)") - micros(start) * F.col("_inside").cast("decimal(20,0)")
    out = met.select(*by, "_inside", far.cast("decimal(38,0)").alias("_far")).groupBy(*by)
    return out.agg(F.sum("_inside").alias("inside"), (F.sum("_far").cast("double") / 1000000).alias("offset"))


def first_existing(wanted: DataFrame, key: str, candidates: list[Column], listing: DataFrame, path: str = "path") -> DataFrame:
    """Each key with the first of its candidate paths that the listing has; null if it has none."""
    tries = wanted.select(key, F.posexplode(F.array(*candidates)).alias("_k", path)).join(listing.select(path).distinct(), path, "left_semi")
    best = tries.groupBy(key).agg(F.min_by(path, "_k").alias(path))
    return wanted.select(key).join(best, key, "left")


def ratio(a: str, b: str) -> float:
    """Similarity by matching blocks: twice the matched characters over all."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


def name_similarity(a: str, b: str) -> float:
    """1 for equal names, 0.9 if one holds the other, else their ratio."""
    a, b = a.lower().strip(), b.lower().strip()
    return 1.0 if a == b else 0.9 if a in b or b in a else ratio(a, b)


def greedy_match(gold: list[str], found: list[str], least: float = 0.5) -> list[int]:
    """For each gold name in order the index of the best unused found name over `least`, or -1."""
    used: set[int] = set()
    out = []
    for g in gold:
        best, score = -1, least
        for k, f in enumerate(found):
            if k not in used and (s := name_similarity(g, f)) > score:
                best, score = k, s
        if best >= 0:
            used.add(best)
        out.append(best)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def greedy_match_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for gold, found in batches:
        yield pd.Series([greedy_match(list(g), list(f)) for g, f in zip(gold, found)])


def assignment(cost: list[list[float]]) -> list[int]:
    """The assignment of rows to columns of least total cost (shortest augmenting paths); -1 for rows left over."""
    n, m = len(cost), len(cost[0]) if cost else 0
    if not n or not m:
        return [-1] * n
    if n > m:
        flipped = assignment([list(c) for c in zip(*cost)])
        out = [-1] * n
        for j, i in enumerate(flipped):
            out[i] = j
        return out
    inf = float("inf")
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, way, seen = [inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[j0]:
            seen[j0] = True
            i0, delta, j1 = owner[j0], inf, 0
            for j in range(1, m + 1):
                if not seen[j]:
                    now = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if now < low[j]:
                        low[j], way[j] = now, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(m + 1):
                if seen[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def _iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union else 0.0


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("iou", T.DoubleType())])))
def optimal_match_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """The pairing of two arrays of boxes with the largest sum of overlaps; pairs without overlap are dropped."""
    out = []
    for x, y in zip(a, b):
        x, y = list(x), list(y)
        over = [[_iou(p, q) for q in y] for p in x]
        found = assignment([[-v for v in row] for row in over])
        out.append([{"i": i, "j": j, "iou": over[i][j]} for i, j in enumerate(found) if j >= 0 and over[i][j] > 0])
    return pd.Series(out)
