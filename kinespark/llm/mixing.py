"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame functions only).

Sources in code-point order, null last, take `weights` in turn and share `share` times all words. No target passes
`limit` times its source's words; the excess is shared again by weight, which is one water level for all. Equal blocks
of `block` words go to the sources by highest quotients (target / 1, 3, 5, ...), and each source's blocks go to its
shards the same way by the shards' words. A shard is the documents whose seeded hash falls to it, in hash order; of
its line of words it gives whole passes, and for what is left an arc of blocks that starts at a seeded block.

Defined results: a null or empty text has size 0 and gives nothing; a null source is a source of its own, last; rows
that repeat are separate documents; quotients and hashes that tie go by source, shard and id; with no words all targets
are 0; very long texts are counted whole; an empty table gives an empty result; other columns, of whatever names, are
ignored by `mix`, and `blend` keeps them but for those with the names of its own.

Scale: the text is read once; (id, source, size, hash) rows go to the shared folder. `blend` also writes the documents
with a number for each row, by which its part of the mix returns to it; that shuffles the texts once. Sources have up to `most_shards`
shards, so that a source with a third of all rows is spread; only the table of sources (one row each, a few more for
quotients near the cut) meets in one task, and only a source's table of shards (at most `most_shards`) in another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tuck, words

WEIGHTS, SHARE, LIMIT, BLOCK, SHARD_WORDS, MOST_SHARDS, SEED = (5, 2, 1), 1.5, 2.0, 16, 32768, 4096, 42


def apportion(votes: DataFrame, within: list[str], vote: str, seats: str, order: list[str], out: str) -> DataFrame:
    """votes with the seats that each row gets of its group's `seats`, by the highest quotients vote / (2k - 1).

    A row's share rounded differs from its result by less than 1.5 (rows + 1) times its share of the votes, plus 2: only
    seats that near are ranked, in all a few times the number of rows.
    """
    group = Window.partitionBy(*within)
    df = votes.withColumns({"_all": F.sum(vote).over(group), "_rows": F.count(F.lit(1)).over(group)})
    part = F.when(F.col("_all") > 0, F.col(vote) / F.col("_all")).otherwise(F.lit(0.0))
    df = df.withColumn("_part", part)
    near = F.ceil(1.5 * (F.col("_rows") + 1) * F.col("_part")) + 2
    df = df.withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_part") * F.col(seats) + 0.5) - near).cast("bigint"))
    df = df.withColumn("_most", (F.floor(F.col("_part") * F.col(seats) + 0.5) + near).cast("bigint"))
    df = df.withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    open_ = df.filter(F.col(vote) > 0).select(*within, *order, vote, "_left", F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))).alias("_k"))
    rank = F.row_number().over(Window.partitionBy(*within).orderBy((F.col(vote) / (2 * F.col("_k") - 1)).desc(), *order, "_k"))
    won = open_.withColumn("_rank", rank).filter("_rank <= _left").groupBy(*within, *order).agg(F.count(F.lit(1)).alias("_won"))
    df = df.join(won, [*within, *order], "left")
    return df.withColumn(out, F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_all", "_rows", "_part", "_sure", "_most", "_left", "_won")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(_src, source, source_size) with target, a double. One row a source: the windows run in one task."""
    df = sizes.withColumn("_one", F.lit(1))
    every = Window.partitionBy("_one")
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last()))
    df = df.withColumn("_place", place).withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") - 1) % len(weights) + 1))
    df = df.withColumns({"_cap": limit * F.col("source_size"), "_total": share * F.sum("source_size").over(every)})
    df = df.withColumn("_full_at", F.col("_cap") / F.col("_weight"))
    by = every.orderBy("_full_at", "_place")
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(rest))
    df = df.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_full_at"), F.struct("_full_at", "_place", "_level"))).over(every)["_level"])
    return df.withColumn("target", F.coalesce(F.least(F.col("_cap"), F.col("_weight") * F.col("_level")), F.col("_cap")))


def _overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT, block: int = BLOCK, shard_words: int = SHARD_WORDS, most_shards: int = MOST_SHARDS, seed: int = SEED, also: tuple = ()) -> DataFrame:
    """One row a document: the columns `also`, doc_id, source, size, source_size, target (its source's) and taken."""
    src = F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("source")))
    mark = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    slim = docs.select(*also, "doc_id", "source", src.alias("_src"), F.size(words(F.col("text"))).cast("bigint").alias("size"), mark.alias("_mark"))
    slim = cut(slim.withColumn("_cell", F.pmod(F.xxhash64(F.lit("cell"), F.col("_mark")), F.lit(most_shards)).cast("int")), "mixing")
    cells = slim.groupBy("_src", "source", "_cell").agg(F.sum("size").alias("_words"))
    wanted = targets(cells.groupBy("_src", "source").agg(F.sum("_words").alias("source_size")), weights, share, limit)
    wanted = wanted.withColumn("_seats", F.round(F.col("_total") / block).cast("bigint"))
    wanted = apportion(wanted, ["_one"], "target", "_seats", ["_place"], "_blocks").select("_src", "source_size", "target", "_blocks")
    parts = F.greatest(F.lit(1), F.least(F.lit(most_shards), F.ceil(F.col("source_size") / shard_words))).cast("int")
    cells = cells.drop("source").join(wanted, "_src").withColumn("_shard", F.col("_cell") % parts)
    shards = cells.groupBy("_src", "_shard", "_blocks").agg(F.sum("_words").alias("_held"))
    shards = apportion(shards, ["_src"], "_held", "_blocks", ["_shard"], "_quota").select("_src", "_shard", "_held", "_quota")
    cells = cells.select("_src", "_cell", "_shard", "source_size", "target").join(shards, ["_src", "_shard"])
    line = Window.partitionBy("_src", "_shard").orderBy("_mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    df = slim.join(cells, ["_src", "_cell"]).withColumn("_from", F.coalesce(F.sum("size").over(line), F.lit(0)))
    df = df.withColumn("_take", F.least(F.col("_quota") * block, F.floor(limit * F.col("_held"))).cast("bigint"))
    some = F.greatest(F.col("_held"), F.lit(1))
    df = df.withColumns({"_passes": F.floor(F.col("_take") / some), "_some": some, "_to": F.col("_from") + F.col("size")})
    df = df.withColumn("_rest", F.col("_take") - F.col("_passes") * F.col("_some"))
    first = F.pmod(F.xxhash64(F.lit(seed), F.lit("arc"), F.col("_src"), F.col("_shard")), F.ceil(F.col("_some") / block)) * block
    df = df.withColumn("_arc", first).withColumn("_end", F.col("_arc") + F.col("_rest"))
    arc = _overlap(F.col("_from"), F.col("_to"), F.col("_arc"), F.least("_end", "_some"))
    arc = arc + _overlap(F.col("_from"), F.col("_to"), F.lit(0), F.col("_end") - F.col("_some"))
    taken = (F.col("_passes") * F.col("size") + arc).cast("bigint")
    return df.select(*also, "doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def blend(docs: DataFrame, **options) -> DataFrame:
    """docs with size, source_size, target and taken: the mixed corpus, in which a document's words count `taken`."""
    keep, own = ("doc_id", "text", "source"), ("size", "source_size", "target", "taken")
    names = [c for c in docs.columns if c not in own]
    held = cut(tuck(docs, *keep).withColumn("_number", F.monotonically_increasing_id()), "blend")
    found = mix(held, also=("_number",), **options).select("_number", F.struct(*own).alias("_mix"))
    found = cut(found, "taken")  # as in secrets.redact: texts are shuffled only if it is large
    return held.join(found, "_number").select(*[(F.col(c) if c in keep else F.col("_row")[c]).alias(c) for c in names], "_mix.*")
