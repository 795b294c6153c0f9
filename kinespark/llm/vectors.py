"""Embedding near-dedup: collisions counted over many sorted one-dimensional projections.

Equal vectors are one node. Each of the tables sorts the nodes by a random projection of their unit vectors, within cells
of `bits` random signs, so that a window of the sorted order holds few strangers. Around each node as the query stands a
window of WIDTH times the distance of two vectors at the limit; nodes within it in the same cell collide in that table.
Collisions are counted for each pair over the tables, and pairs with COUNT or more are verified on the vectors in double
precision. `calibrated` gives the bits by the number of nodes and the tables by a recall: two vectors exactly at the limit
collide in a table with a known chance, and there are as many tables as it takes to reach COUNT with chance RECALL.

Near copies aren't paired one by one. A node hangs on the leader (the smallest node of a cell) with which it collides in
most of ELECTING tables, where their angle is below half the limit's: all nodes of such a ball are linked with one another,
by the triangle inequality of angles. What is sorted, counted and verified are balls (a ball's entry in a cell spans its
nodes' projections). Two balls' centres and radii show whether all their pairs are linked or none; only where that is open
their nodes are compared, in blocks, which give each node its count and no pairs.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component links with nothing, and is kept;
vectors of different lengths don't link; rows that repeat, also under one vec_id, are vectors of their own; a null vec_id
is the smallest of no component that has another id; an empty table gives an empty result; columns beyond vec_id and
embedding are ignored. A pair at the limit is missed with chance 1 - RECALL at most, a closer one far less often; none below the
limit is linked.

Scale: vectors are read once, and shuffled for the verification of their candidates only. Each node has a row of some 40
bytes in every table: 50 tables for 51,000 nodes, 454 for 10^9, as the nodes to the power 0.22, which is what cells of
random signs cost at a cosine of 0.9. Vectors of which a large part lie in a narrow cone
without being near copies fill their cells, whose windows then grow with it; Spark splits such cells in its joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import cut, scratch
from .components import components

LIMIT, RECALL, SEED = 0.9, 0.99, 13
#: Nodes of a cell, collisions of a candidate, window in distances at the limit, tables that elect leaders, nodes of a block.
CELL, COUNT, WIDTH, ELECTING, BLOCK = 8, 2, 2.0, 16, 512
#: Angles are judged apart from each other only beyond this, far above their rounding.
MARGIN = 1e-6


def calibrated(nodes: int, limit: float = LIMIT, recall: float = RECALL, count: int = COUNT) -> tuple[int, int, float]:
    """(bits of a cell, tables, half width of a window) for a number of nodes."""
    bits = min(60, max(1, math.ceil(math.log2(max(nodes, 2) / CELL))))
    apart = math.sqrt(2 - 2 * limit)
    one = (1 - math.acos(limit) / math.pi) ** bits * math.erf(WIDTH / math.sqrt(2))
    tables = count
    while sum(math.comb(tables, k) * one**k * (1 - one) ** (tables - k) for k in range(count)) > 1 - recall:
        tables += 1
    return bits, tables, WIDTH * apart


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, node (null for a vector that can't link) and unit."""
    import numpy as np
    import xxhash

    for batch in batches:
        nodes, units = [], []
        for x in batch.column("v"):
            held = x.values if x.is_valid else None
            v = np.zeros(0) if held is None or held.null_count else held.to_numpy(zero_copy_only=False) + 0.0  # no -0.0
            top = np.abs(v).max(initial=0.0)
            if not 0 < top < np.inf:  # nor NaN
                nodes.append(None)
                units.append(None)
                continue
            scaled = v / top  # squares neither overflow nor vanish
            nodes.append(xxhash.xxh3_128_digest(v.tobytes()))
            units.append(scaled / np.sqrt(scaled @ scaled))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nodes, pa.binary()), pa.array(units, pa.list_(pa.float64()))], ["vec_id", "node", "unit"])


@lru_cache(maxsize=256)
def _directions(seed: int, table: int, length: int, bits: int):
    import numpy as np

    return np.random.default_rng([seed, table, length]).standard_normal((length, bits + 1))


def _projected(bits: int, tables: int, width: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        weights = 1 << np.arange(bits, dtype="i8")
        for batch in batches:
            lengths = pc.list_value_length(batch.column("unit"))
            for length in pc.unique(lengths).to_pylist():
                own = batch.filter(pc.equal(lengths, length))
                units = own.column("unit").flatten().to_numpy().reshape(-1, length)
                for table in range(tables):
                    p = units @ _directions(seed, table, length, bits)
                    made = [pa.array(np.full(len(p), table), pa.int32()), pa.array((p[:, 1:] > 0) @ weights), pa.array(np.floor(p[:, 0] / width).astype("i4")), pa.array(p[:, 0].astype("f4"))]
                    yield pa.RecordBatch.from_arrays([*made, own.column("node")], ["table", "cell", "slab", "p", "node"])

    return run


def _cosines(batch: pa.RecordBatch):
    """The cosine of each row's unit vectors x and y; -2 where their lengths differ."""
    import numpy as np
    import pyarrow.compute as pc

    x, y = batch.column("x"), batch.column("y")
    fits = pc.equal(pc.list_value_length(x), pc.list_value_length(y))
    out, at = np.full(len(x), -2.0), fits.to_numpy(zero_copy_only=False)
    if at.any():
        x, y = x.filter(fits), y.filter(fits)
        starts = np.cumsum(pc.list_value_length(x).to_numpy()) - pc.list_value_length(x).to_numpy()
        out[at] = np.add.reduceat(x.flatten().to_numpy() * y.flatten().to_numpy(), starts)
    return out


def _angle(cosines):
    import numpy as np

    return np.arccos(np.clip(cosines, -1, 1))


def _hung(limit: float):
    """node, ball and radius where a node's leader is within half the limit's angle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = _cosines(batch)
            angle, near = _angle(cosine), cosine >= -1.5
            near &= angle <= math.acos(limit) / 2 - MARGIN
            made = pa.RecordBatch.from_arrays([batch.column("node"), batch.column("ball"), pa.array(angle)], ["node", "ball", "radius"])
            yield made.filter(pa.array(near))

    return run


def _judged(limit: float):
    """a, b and whether all pairs of two balls are linked, or only some may be; none for pairs of which none is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            cosine, most = _cosines(batch), math.acos(limit)
            reach = batch.column("radius_a").to_numpy() + batch.column("radius_b").to_numpy()
            angle, single = _angle(cosine), reach == 0
            every = np.where(single, cosine >= limit, angle + reach <= most - MARGIN)
            some = ~every & ~single & (angle - reach <= most + MARGIN)
            made = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(every)], ["a", "b", "every"])
            yield made.filter(pa.array((every | some) & (cosine >= -1.5)))

    return run


def _block(limit: float):
    """a, b, node and n: the vectors of the other side linked with each node of a block of two balls."""

    def run(rows: pa.Table) -> pa.Table:
        import numpy as np

        side, sizes = rows["side"].to_numpy(), rows["size"].to_numpy()
        units = rows["unit"].combine_chunks().flatten().to_numpy().reshape(len(side), -1)
        linked = units[side == 0] @ units[side == 1].T >= limit
        n = np.zeros(len(side), "i8")
        n[side == 0], n[side == 1] = linked @ sizes[side == 1], sizes[side == 0] @ linked
        return pa.table({"a": rows["a"], "b": rows["b"], "node": rows["node"], "n": pa.array(n)}).filter(pa.array(n > 0))

    return run


def _balls(nodes: DataFrame, cells: DataFrame, limit: float) -> DataFrame:
    """node, size, first, ball and radius: each node hangs on a leader near it or is a ball of its own."""
    votes = cells.filter(F.col("table") < ELECTING)
    leaders = votes.groupBy("table", "cell").agg(F.min("node").alias("ball"))
    votes = votes.select("table", "cell", "node").join(leaders, ["table", "cell"]).filter("node != ball")
    votes = votes.groupBy("node", "ball").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COUNT)
    chosen = votes.groupBy("node").agg(F.max_by("ball", F.struct("n", "ball")).alias("ball"))
    pairs = chosen.join(nodes.select("node", F.col("unit").alias("x")), "node")
    pairs = pairs.join(nodes.select(F.col("node").alias("ball"), F.col("unit").alias("y")), "ball")
    hung = pairs.select("node", "ball", "x", "y").mapInArrow(_hung(limit), "node binary, ball binary, radius double")
    out = nodes.select("node", "size", "first").join(hung, "node", "left")
    return cut(out.withColumns({"ball": F.coalesce("ball", "node"), "radius": F.coalesce("radius", F.lit(0.0))}), "balls")


def _candidates(cells: DataFrame, members: DataFrame, width: float) -> DataFrame:
    """(a, b): pairs of balls that collide in COUNT tables or more."""
    entries = cells.join(members.select("node", "ball"), "node").groupBy("table", "cell", "slab", "ball").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    entries = cut(entries, "entries")
    # A window reaches into the next slab at most; the pair is made at the lower one.
    beside = entries.select("table", "cell", F.explode(F.array(F.struct(F.col("slab"), F.lit(False).alias("next")), F.struct((F.col("slab") - 1).alias("slab"), F.lit(True).alias("next")))).alias("_s"), F.col("ball").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    beside = beside.select("table", "cell", "_s.*", "b", "b_low", "b_high")
    met = entries.withColumnRenamed("ball", "a").join(beside, ["table", "cell", "slab"])
    met = met.filter((F.col("a") < F.col("b")) | (F.col("next") & (F.col("a") != F.col("b"))))
    met = met.filter((F.col("b_low") <= F.col("high") + width) & (F.col("b_high") >= F.col("low") - width))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "table").distinct()
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COUNT).select("a", "b")


def _opened(some: DataFrame, members: DataFrame, nodes: DataFrame, balls: DataFrame, limit: float, block: int) -> DataFrame:
    """The counts of _block for pairs of balls that are linked in part."""
    blocks = balls.select("ball", F.ceil(F.col("nodes") / block).cast("int").alias("k"))
    some = some.join(blocks.select(F.col("ball").alias("a"), F.col("k").alias("ka")), "a").join(blocks.select(F.col("ball").alias("b"), F.col("k").alias("kb")), "b")
    held = members.select("ball", "node", "size").join(nodes.select("node", "unit"), "node")

    def side(mine: str, other: str, at: int) -> DataFrame:
        own = F.pmod(F.xxhash64("node"), F.col(f"k{mine}")).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col(f"k{other}") - 1))
        rows = some.join(held.withColumnRenamed("ball", mine), mine)
        return rows.select("a", "b", own.alias(f"i{mine}"), each.alias(f"i{other}"), F.lit(at).alias("side"), "node", "size", "unit")

    rows = side("a", "b", 0).unionByName(side("b", "a", 1))
    return rows.groupBy("a", "b", "ia", "ib").applyInArrow(_block(limit), "a binary, b binary, node binary, n long")


def links(vectors: DataFrame, limit: float = LIMIT, recall: float = RECALL, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """One row a vector (vec_id, embedding): vec_id, n_links, component_id and kept."""
    with scratch() as keep:
        schema = vectors.select("vec_id").schema.add("node", "binary").add("unit", ArrayType(DoubleType()))
        read = cut(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).mapInArrow(_read, schema), "vectors")
        keep.append(read)
        nodes = read.filter(F.col("node").isNotNull()).groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("first"), F.first("unit").alias("unit"))
        nodes = cut(nodes, "nodes")
        bits, tables, width = calibrated(nodes.count(), limit, recall)
        cells = nodes.select("node", "unit").mapInArrow(_projected(bits, tables, width, seed), "table int, cell long, slab int, p float, node binary")
        cells = cut(cells, "cells")
        members = _balls(nodes, cells, limit)
        balls = cut(members.groupBy("ball").agg(F.max("radius").alias("radius"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("nodes"), F.min("first").alias("first")), "centres")
        centres = balls.join(nodes.select(F.col("node").alias("ball"), "unit"), "ball")
        pairs = _candidates(cells, members, width)
        for mine, unit in (("a", "x"), ("b", "y")):
            pairs = pairs.join(centres.select(F.col("ball").alias(mine), F.col("unit").alias(unit), F.col("radius").alias(f"radius_{mine}")), mine)
        judged = cut(pairs.mapInArrow(_judged(limit), "a binary, b binary, every boolean"), "judged")
        whole = judged.filter("every").select("a", "b")
        part = cut(_opened(judged.filter("not every").select("a", "b"), members, nodes, balls, limit, block), "opened")
        both = whole.union(whole.select("b", "a"))
        of_balls = both.join(balls.select(F.col("ball").alias("b"), "size"), "b").groupBy(F.col("a").alias("ball")).agg(F.sum("size").alias("_whole"))
        of_nodes = part.groupBy("node").agg(F.sum("n").alias("_part"))
        roots = components(whole.union(part.select("a", "b").distinct()))
        rooted = balls.join(of_balls, "ball", "left").join(roots.withColumnRenamed("node", "ball"), "ball", "left").withColumn("root", F.coalesce("root", "ball"))
        least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        rooted = rooted.join(least, "root").select("ball", (F.col("size") - 1 + F.coalesce("_whole", F.lit(0))).alias("_links"), "component_id")
        found = members.join(rooted, "ball").join(of_nodes, "node", "left")
        found = cut(found.select("node", (F.col("_links") + F.coalesce("_part", F.lit(0))).alias("n_links"), "component_id"), "links")
        keep.append(found)
    out = read.select("vec_id", "node").join(found, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def sql(limit: float = LIMIT) -> str:
    """The same without a miss, in DuckDB's SQL, by all pairs; ids must be unique."""
    good = "e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0"
    return f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), good AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS s FROM v WHERE {good}),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.s * b.s) >= {limit}),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a), m AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(m, vec_id), vec_id) AS component_id, coalesce(least(m, vec_id), vec_id) = vec_id AS kept FROM v LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id)"""
