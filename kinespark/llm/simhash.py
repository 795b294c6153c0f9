"""SimHash near-dedup: fingerprints linked by way of pivot distance tables.

A fingerprint is cut into four segments of 16 bits. For each segment the distances to `PIVOTS` reference segments are
its coordinates. The largest coordinate difference bounds a segment's Hamming distance from below, and their sum over
the segments bounds the whole one: a pair may be linked only if that sum is at most `MOST` (2), so at least two of the
four segments have equal coordinates. Fingerprints meet by equal coordinates of two segments (six tables), pairs whose
sum of largest differences is above MOST are discarded, and survivors are verified on all bits.

Where more than `DENSE` fingerprints share coordinates, pairs aren't made. There each fingerprint is set beside those at
one bit from it, and all that share one of these are hung on the smallest: two fingerprints are within two bits exactly
if they share one, and at most 65 can. Pairs of a dense cell have both their fingerprints in that set, so no link is
lost. Links among a class are fewer than its pairs, but its components are the same.

`similar` and `dedup` link by another rule: sets of 5-word shingles with a Jaccard similarity of 0.8 or more. Their
fingerprints differ by 10 bits on average and by up to RADIUS (28), where equal coordinates of segments find nothing, so
pivot tables can't propose pairs. Documents meet by bands of minimal shingle hashes instead: 20 bands of 5, which a pair
at 0.8 misses once in 2,900. Of the pairs that meet, those whose sizes differ too far or whose largest coordinate
differences sum to more than RADIUS are discarded, and survivors are verified on all bits and then on the whole sets, so
a link is exact. Rows of a band of more than CROWD are set beside the band's smallest; then every row outside the band's
largest component is asked against all rows of other components, so no pair that could join two components is left out.
That is done on whole sets, in blocks of BLOCK shingles, without a row for each pair: time grows with a crowded band's rows
times those outside its largest component, rows and bytes with their number times the band's blocks.

Defined results: a text without words (or null) has fingerprint 0, which is linked like others by `classes`, and all such
texts are one class of `similar`; equal fingerprints are one node; a null doc_id has a fingerprint and a component but is the smallest of none that has another id; rows that
share a doc_id are linked by their texts only, and `dedup` keeps one row of each component, of the smallest doc_id and
of equal ones (ties) the smallest hash of the text; very long texts are read whole; an empty table gives an empty result;
columns beyond doc_id and text, of whatever names, pass through `dedup` and are ignored by `classes`.

Scale: texts are read once, in Arrow batches, and never shuffled by `classes`; distinct fingerprints are shuffled six
times as rows of 40 bytes, dense ones 65 times as rows of 16. `similar` reads texts once more for each verification and
shuffles those that have a candidate partner, as sets of 8 bytes a shingle; distinct sets are shuffled 20 times as rows of
50 bytes.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import cut, row_key, scratch, tuck, untuck
from .components import components

SEED, SHINGLE, MOST, DENSE, PIVOTS, SEGMENTS = 42, 3, 2, 32, 12, 4
#: Of `similar`: words a shingle, similarity, bits that similar sets may differ by, rows of a band that are paired.
WORDS, SIMILAR, RADIUS, CROWD = 5, 0.8, 28, 8
#: Bands of minima, and minima a band.
BANDS, DEPTH = 20, 5
#: Shingles of a block of a crowded band: 4 MB.
BLOCK = 1 << 19
#: Reference segments, drawn once.
REFERENCES = [[random.Random(f"{s}.{r}").getrandbits(16) for r in range(PIVOTS)] for s in range(SEGMENTS)]


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text, as a signed integer."""
    import numpy as np
    import xxhash

    # bytes.lower() and bytes.split() know ASCII only: A-Z, and white space as it is defined here.
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(found) <= size:
        return int(np.array([hashed(b" ".join(found), seed)], "u8").view("i8")[0])
    votes, n = np.zeros(64, "i8"), len(found) - size + 1
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = found[at : min(n, at + (1 << 16)) + size - 1]
        codes = np.array([hashed(b" ".join(x), seed) for x in zip(*[part[k:] for k in range(size)])], ">u8")
        votes += np.unpackbits(codes.view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="i8")
    return int(np.packbits(votes * 2 > n).view(">i8")[0])


def _batches(size: int, seed: int, keep: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t, size, seed) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(marks, pa.int64())], [*keep, "mark"])

    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns `keep` and mark, the fingerprint as a signed long, for each document."""
    schema = docs.select(*keep).schema.add("mark", "long")
    return docs.select(*keep, "text").mapInArrow(_batches(size, seed, keep), schema)


def _segment(mark: Column, s: int) -> Column:
    return F.shiftrightunsigned(mark, 48 - 16 * s).bitwiseAND(F.lit(0xFFFF))


def _coordinates(mark: Column, s: int) -> list[Column]:
    return [F.bit_count(_segment(mark, s).bitwiseXOR(F.lit(r))) for r in REFERENCES[s]]


def _table(mark: Column, s: int) -> Column:
    """A segment's coordinates in one long, five bits each."""
    out = F.lit(0).cast("bigint")
    for k, c in enumerate(_coordinates(mark, s)):
        out = out.bitwiseOR(F.shiftleft(c.cast("bigint"), 5 * k))
    return out


def _bound(a: Column, b: Column) -> Column:
    """The sum over segments of the largest difference of their coordinates: never above the Hamming distance."""
    return sum((F.greatest(*[F.abs(x - y) for x, y in zip(_coordinates(a, s), _coordinates(b, s))]) for s in range(SEGMENTS)), F.lit(0))


def links(marks: DataFrame, most: int = MOST, dense: int = DENSE) -> DataFrame:
    """(a, b): links among distinct `mark`s that give all components of pairs at up to `most` (2) bits."""
    if most != 2:
        raise ValueError("the tables are laid out for two bits")
    sides = [(s, t) for s in range(SEGMENTS) for t in range(s + 1, SEGMENTS)]
    tables = marks.select("mark", *[_table(F.col("mark"), s).alias(f"t{s}") for s in range(SEGMENTS)])
    cells = tables.select("mark", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"t{s}").alias("x"), F.col(f"t{t}").alias("y")) for k, (s, t) in enumerate(sides)])).alias("c")).select("mark", "c.*")
    sizes = cells.groupBy("k", "x", "y").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = cut(cells.join(sizes, ["k", "x", "y"]), "pivots")
    few = met.filter(F.col("n") <= dense)
    pairs = few.alias("p").join(few.select("k", "x", "y", F.col("mark").alias("b")).alias("q"), ["k", "x", "y"]).filter("mark < b")
    pairs = pairs.select(F.col("mark").alias("a"), "b").filter(_bound(F.col("a"), F.col("b")) <= most)
    pairs = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)
    many = met.filter(F.col("n") > dense).select("mark").distinct()
    beside = F.array(F.lit(0).cast("bigint"), *[F.shiftleft(F.lit(1).cast("bigint"), k) for k in range(64)])
    near = many.select("mark", F.explode(beside).alias("flip")).select("mark", F.col("mark").bitwiseXOR(F.col("flip")).alias("z"))
    stars = near.groupBy("z").agg(F.sort_array(F.collect_set("mark")).alias("s")).filter(F.size("s") > 1)  # at most 65
    stars = stars.select(F.get("s", F.lit(0)).alias("a"), F.explode(F.slice("s", 2, 64)).alias("b"))
    return pairs.union(stars)


def _rooted(docs: DataFrame, size: int, seed: int, keep: tuple) -> DataFrame:
    """The columns `keep`, mark, root (a mark that stands for the component) and component_id of each document."""
    marks = cut(fingerprints(docs, size, seed, keep), "fingerprints")
    nodes = cut(marks.groupBy("mark").agg(F.min("doc_id").alias("first")), "marks")
    roots = components(links(nodes.select("mark")))
    rooted = nodes.join(roots, nodes["mark"] == roots["node"], "left").select("mark", "first", F.coalesce("root", "mark").alias("root"))
    # Components of one fingerprint need no further step.
    alone, linked = rooted.join(roots.select("root").distinct(), "root", "left_anti"), rooted.join(roots.select("root").distinct(), "root", "left_semi")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = linked.join(least, "root").select("mark", "root", "component_id")
    found = linked.union(alone.select("mark", "root", F.col("first").alias("component_id")))
    return marks.join(found, "mark").select(*keep, "mark", "root", "component_id")


def classes(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    out = _rooted(docs, size, seed, ("doc_id",))
    return out.select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


def _shingles(text: str | None, size: int, seed: int):
    """The distinct shingle hashes of a text in order; none for a text without words."""
    import numpy as np
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, "u8")
    rows = zip(*[found[k:] for k in range(size)]) if len(found) > size else [found]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(x), seed) for x in rows), "u8"))


def _sketches(size: int, seed: int, keep: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        rng = random.Random(seed)
        odd = np.array([rng.getrandbits(64) | 1 for _ in range(BANDS * DEPTH)], "u8")
        for batch in batches:
            nodes, marks, sizes, bands = [], [], [], []
            for text in batch.column("text").to_pylist():
                codes = _shingles(text, size, seed)
                nodes.append(xxhash.xxh3_128_digest(codes.tobytes()))
                sizes.append(len(codes))
                votes, least = np.zeros(64, "i8"), np.full(len(odd), 2**64 - 1, "u8")
                for at in range(0, len(codes), 1 << 12):  # bounded memory for very long texts
                    part = codes[at : at + (1 << 12)]
                    votes += np.unpackbits(part.astype(">u8").view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="i8")
                    least = np.minimum(least, (part[:, None] * odd).min(axis=0))
                marks.append(int(np.packbits(votes * 2 > len(codes)).view(">i8")[0]))
                rows = least.reshape(BANDS, DEPTH)
                bands.append([xxhash.xxh64_intdigest(r.tobytes(), k) - 2**63 for k, r in enumerate(rows)])
            made = [pa.array(nodes, pa.binary()), pa.array(marks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], [*keep, "node", "mark", "n", "bands"])

    return run


def _sets(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [_shingles(t, size, seed).view("i8") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(held, pa.list_(pa.int64()))], ["node", "codes"])

    return run


def _near(p: str, q: str) -> Column:
    """Whether two rows with n and mark may be similar: by their sizes, their pivots' bound, and all bits."""
    a, b = F.col(f"{p}.mark"), F.col(f"{q}.mark")
    sizes = F.least(f"{p}.n", f"{q}.n") / F.greatest(f"{p}.n", f"{q}.n") >= SIMILAR
    return sizes & (_bound(a, b) <= RADIUS) & (F.bit_count(a.bitwiseXOR(b)) <= RADIUS)


def _codes(members: DataFrame, held: DataFrame, nodes: DataFrame, size: int, seed: int) -> DataFrame:
    """node and codes, its set of shingles, of each node of `members`."""
    texts = cut(nodes.join(members, "node", "left_semi").select("node", F.col("first").alias("_first")), "members")
    texts = held.join(texts, held["_key"] == texts["_first"]).select("node", "text").dropDuplicates(["node"])
    return cut(texts.mapInArrow(_sets(size, seed), "node binary, codes array<bigint>"), "sets")


def _verified(pairs: DataFrame, held: DataFrame, nodes: DataFrame, size: int, seed: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least SIMILAR."""
    pairs = cut(pairs.distinct(), "candidates")
    sets = _codes(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), held, nodes, size, seed)
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("codes").alias("y")), "b")
    both = both.join(sets.select(F.col("node").alias("a"), F.col("codes").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    return cut(both.filter(common / (F.size("x") + F.size("y") - common) >= SIMILAR).select("a", "b"), "similar")


def _block(rows: pa.Table) -> pa.Table:
    """Links (a, b) that join the components (root) of a block's asked rows with those of its other rows, no more than do.

    A set of n shingles that is similar to another shares at least `need` of them with it, so it shares one of any
    n - need + 1: rows that share none of an asked row's rarest ones aren't counted.
    """
    import numpy as np

    nodes, asked = rows["node"].to_pylist(), rows["asked"].to_numpy(zero_copy_only=False)
    group = np.unique(np.array([r.hex() for r in rows["root"].to_pylist()]), return_inverse=True)[1]
    held = rows["codes"].combine_chunks()
    ends, codes = held.offsets.to_numpy(), held.values.to_numpy()
    lengths = np.diff(ends)
    owners = np.repeat(np.arange(len(nodes)), lengths)
    beside = ~asked[owners]
    order = np.argsort(codes[ends[0] : ends[-1]][beside], kind="stable")
    known, owners = codes[ends[0] : ends[-1]][beside][order], owners[beside][order]
    out = []
    for u in np.flatnonzero(asked):
        own, n = codes[ends[u] : ends[u + 1]], lengths[u]
        low, high = np.searchsorted(known, own, "left"), np.searchsorted(known, own, "right")
        need = int(np.ceil(SIMILAR * n - 1e-9))
        rare = np.argsort(high - low, kind="stable")[: n - need + 1]
        if not any((group[owners[low[k] : high[k]]] != group[u]).any() for k in rare):
            continue
        common = np.bincount(np.concatenate([owners[i:j] for i, j in zip(low, high)]), minlength=len(nodes))
        for v in np.flatnonzero((common / (n + lengths - common) >= SIMILAR) & ~asked):
            if group[v] != group[u]:
                out.append((nodes[u], nodes[v]))
                group[group == group[u]] = group[v]
    return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})


def _rest(met: DataFrame, roots: DataFrame, held: DataFrame, nodes: DataFrame, size: int, seed: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) among crowded bands' rows that aren't in one component yet, judged on whole sets.

    Pairs within a component need no further link. Of the others at least one isn't in its band's largest component, so
    each row outside that one is asked against the band's other rows. A band is cut into blocks of about `block` shingles,
    and each block of asked rows meets each block of all rows in a task of its own; only links leave it.
    """
    known = cut(met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "known")
    sizes = known.groupBy("x", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    bands = sizes.groupBy("x").agg(F.max(F.struct("c", "root")).alias("m"), F.count(F.lit(1)).alias("roots"), F.ceil(F.sum("n") / block).cast("int").alias("k"))
    bands = bands.filter("roots > 1").select("x", "k", F.col("m.root").alias("main"))
    mixed = known.join(bands, "x").select("x", "k", "node", "root", (F.col("root") != F.col("main")).alias("out"), F.pmod(F.xxhash64("node"), "k").cast("int").alias("own"))
    mixed = cut(mixed, "mixed")
    sets = _codes(mixed.select("node").distinct(), held, nodes, size, seed)
    each = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    asked = mixed.filter("out").select("x", F.col("own").alias("i"), each.alias("j"), F.lit(True).alias("asked"), "node", "root")
    beside = mixed.select("x", each.alias("i"), F.col("own").alias("j"), F.lit(False).alias("asked"), "node", "root")
    rows = asked.union(beside).join(sets, "node")
    return rows.groupBy("x", "i", "j").applyInArrow(_block, "a binary, b binary")


def similar(docs: DataFrame, size: int = WORDS, seed: int = SEED, dense: int = CROWD, block: int = BLOCK) -> DataFrame:
    """doc_id, _key, node and root of each document (doc_id, text, _key): node names its set of shingles, root its class.

    Classes are the components of links between sets whose Jaccard similarity is at least SIMILAR.
    """
    held = docs.select("doc_id", "text", "_key")
    schema = docs.select("doc_id", "_key").schema.add("node", "binary").add("mark", "long").add("n", "long").add("bands", ArrayType(LongType()))
    marks = cut(held.mapInArrow(_sketches(size, seed, ("doc_id", "_key")), schema), "sketches")
    firsts = marks.groupBy("node").agg(F.min("_key").alias("first"), F.min("mark").alias("mark"), F.min("n").alias("n"), F.min("bands").alias("bands"))
    nodes = cut(firsts, "nodes")
    cells = nodes.filter("n > 0").select("node", "mark", "n", F.explode("bands").alias("x"))
    sizes = cells.groupBy("x").agg(F.count(F.lit(1)).alias("held"), F.min(F.struct("node", "mark", "n")).alias("q")).filter("held > 1")
    met = cut(cells.join(sizes, "x"), "bands")
    few, many = met.filter(F.col("held") <= dense).drop("q"), met.filter(F.col("held") > dense)
    pairs = few.alias("p").join(few.alias("q"), "x").filter(F.col("p.node") < F.col("q.node")).filter(_near("p", "q"))
    pairs = pairs.select(F.col("p.node").alias("a"), F.col("q.node").alias("b"))
    stars = many.select(F.struct("node", "mark", "n").alias("p"), "q").filter(F.col("p.node") != F.col("q.node")).filter(_near("p", "q"))
    stars = stars.select(F.col("q.node").alias("a"), F.col("p.node").alias("b"))
    found = _verified(pairs.union(stars), held, nodes, size, seed)
    roots = cut(components(found), "roots")
    rest = cut(_rest(many.drop("q"), roots, held, nodes, size, seed, block).distinct(), "rest")
    if not rest.isEmpty():
        roots = cut(components(found.union(rest)), "roots")
    rooted = marks.join(roots, "node", "left")
    return rooted.select("doc_id", "_key", "node", F.coalesce("root", "node").alias("root"))


def dedup(docs: DataFrame, size: int = WORDS, seed: int = SEED) -> DataFrame:
    """One document of each class of `similar`, that of the smallest doc_id, with the columns of docs."""
    names, keep = docs.columns, ("doc_id", "text")
    held = tuck(docs, *keep).withColumn("_key", row_key("text"))
    with scratch() as stays:
        found = cut(similar(held, size, seed), "classes")
        stays.append(found)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("_id"), F.col("_key").alias("_k"))).alias("x"))
    first = cut(first.select("x._id", "x._k"), "first")
    same = lambda df: df.join(first, df["doc_id"].eqNullSafe(first["_id"]) & (df["_key"] == first["_k"]), "left_semi")
    kept = same(held)
    if same(found).count() > first.count():  # rows that are equal in id and text
        kept = kept.dropDuplicates(["doc_id", "_key"])
    return untuck(kept, names, *keep)
