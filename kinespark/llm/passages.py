"""Substring dedup: passages that repeat across documents, by collinear chaining.

Seeds are the K-word windows with the smallest hash among each W neighbouring ones, so that any shared run of K + W - 1
words shares a seed. A seed that more than one document holds is joined to its first holder (the smallest doc_id, and
there the first place), which gives one match a seed, however many hold it: a group of n copies gives n - 1 rows of
matches, not their pairs, and each member is linked to the first.

A passage's seeds may have different first holders, where smaller ids hold snippets of it. So each run of 2 and of 4
neighbouring seeds whose first holders differ, or don't lie in line, is a key of its own, and is joined to the first
holder of the whole run. Whether a run is such a key depends on its seeds only, so all its holders agree.

The matches of two documents are chained in order of both, with a cost for the gap between neighbours, through a Fenwick
tree over the places in the first document. A chain is then aligned word by word from its first match to both sides, over
insertions, deletions and changes of up to SKIP words. Where that ends, it starts again from the chain's next match
beyond, until none is left. Each stretch is judged on its own and kept as a passage if it spans at least LEAST words in
both documents and SIMILAR of them agree. The words of the chain and MARGIN on either side are looked at first; a chain
whose passage comes near their edge is aligned again with WIDER times as many, until none does, the text ends, or another
passage of the document goes on there: then all its repeated words are known, and this first holder's part stays cut.

Defined results: a null doc_id can't be named in a result and gives none; a null text, an empty one or one of fewer than
K words has no seeds; rows that share a doc_id are one document (equal ones count once); of several holders the smallest
id is the first, and of several places in it the first (ties); passages repeated within one document only are not its
subject; very long texts are read whole; an empty table gives an empty result; other columns, of whatever names, are
ignored.

Scale: (hash, doc_id, place) rows for about a fifth of the words are written once and shuffled twice, once combined by
hash and once to join what is repeated, which Spark can split where a seed is frequent; then matches go by document, all
texts by doc_id to meet the segments of chains, and only these segments by chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, words

K, W, LEAST, SIMILAR, SKIP, GAP = 5, 8, 50, 0.8, 12, 0.25
#: Words around a chain that are aligned at first, and how many times more where they don't do.
MARGIN, WIDER = 48, 8
#: A chain spans so many words at least; and the numbers of neighbouring seeds that are keys of their own.
REACH, RUNS = 6, (2, 4)


def seeds_of(found: list[bytes], k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of a text's seeds, given its words."""
    import xxhash

    if len(found) < k:
        return np.zeros(0, "u8"), np.zeros(0, "i8")
    digest = xxhash.xxh64_intdigest
    each = np.array([digest(x) for x in found], "u8")
    h = np.zeros(len(each) - k + 1, "u8")
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + each[j : j + len(h)]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    if len(h) <= w:
        places = np.array([int(h.argmin())])
    else:
        windows = np.lib.stride_tricks.sliding_window_view(h, w)
        places = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
    return h[places], places


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        hashes, places, numbers = [], [], []
        for t in texts:
            h, p = seeds_of((t or "").encode("utf-8", "surrogatepass").split())
            hashes.append(h)
            places.append(p)
            numbers.append(np.arange(len(h)))
        at = pa.array(np.repeat(np.arange(len(texts)), [len(h) for h in hashes]))
        values = [np.concatenate(x) if x else np.zeros(0) for x in (hashes, places, numbers)]
        yield pa.RecordBatch.from_arrays([pa.array(values[0].astype("u8").view("i8")), ids.take(at), *[pa.array(x.astype("i4")) for x in values[1:]]], ["h", "doc", "at", "n"])


def chain(at: np.ndarray, at0: np.ndarray, k: int = K, gap: float = GAP) -> list[tuple]:
    """Disjoint chains of matches (at in one text, at0 in the other): (first at, last at, first at0, last at0, and all
    its at and at0, in order).

    A chain's score is k a match less `gap` for each word between neighbours in either text; both rise along it.
    f(j) = k + max(0, max over i before j of f(i) - cost(i, j)); cost parts into a term of i and one of j, so the
    maximum is a prefix maximum over at0, kept in a Fenwick tree.
    """
    order = np.lexsort((-at0, at))  # of equal places the largest first, so that none follows another
    at, at0 = at[order].tolist(), at0[order].tolist()
    ranks = {v: r for r, v in enumerate(sorted(set(at0)), 1)}
    size = len(ranks)
    tree = [(-1e18, -1)] * (size + 1)
    score, back = [0.0] * len(at), [-1] * len(at)
    for j, (x, y) in enumerate(zip(at, at0)):
        r, best = ranks[y] - 1, (-1e18, -1)
        while r > 0:
            if tree[r] > best:
                best = tree[r]
            r &= r - 1
        reach = best[0] - gap * (x + y - 2 * k) + 0.0
        score[j] = float(k)
        if best[1] >= 0 and reach > 0:
            score[j], back[j] = k + reach, best[1]
        entry, r = (score[j] + gap * (x + y), j), ranks[y]
        while r <= size:
            if entry > tree[r]:
                tree[r] = entry
            r += r & -r
    used, out = [False] * len(at), []
    for j in sorted(range(len(at)), key=lambda j: (-score[j], j)):
        if used[j]:
            continue
        i, held = j, []
        while i >= 0 and not used[i]:
            used[i] = True
            held.append(i)
            i = back[i]
        held.reverse()
        out.append((at[held[0]], at[j], at0[held[0]], at0[j], [at[i] for i in held], [at0[i] for i in held]))
    return out


def runs(h: np.ndarray, n: np.ndarray, at: np.ndarray, first: np.ndarray, at0: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, from, to) for each run of neighbouring seeds of a document that needs a first holder of its own. The seeds
    are in order of their places, and n numbers all seeds of the document; places are indices into these arrays."""
    beside = n[1:] == n[:-1] + 1
    astray = (first[1:] != first[:-1]) | (np.abs((at0[1:] - at0[:-1]) - (at[1:] - at[:-1])) > SKIP)
    for size in RUNS:
        if len(h) < size:
            return
        whole, odd, key = np.ones(len(h) - size + 1, bool), np.zeros(len(h) - size + 1, bool), np.full(len(h) - size + 1, size, "u8")
        for k in range(size):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(key)]
            if k:
                whole &= beside[k - 1 : k - 1 + len(key)]
                odd |= astray[k - 1 : k - 1 + len(key)]
        for i in np.flatnonzero(whole & odd).tolist():
            yield int(key[i].view("i8")), i, i + size


def _documents(batches: Iterator[pa.RecordBatch], names: tuple) -> Iterator[tuple]:
    """(doc, its values of each name, the type of doc), of rows in order of doc."""
    held: list[list] = [[] for _ in names]
    doc = kind = None
    for batch in batches:
        kind = batch.column("doc").type
        docs, columns = batch.column("doc").to_pylist(), [batch.column(c).to_pylist() for c in names]
        start = 0
        while start < len(docs):
            end = start + 1
            while end < len(docs) and docs[end] == docs[start]:
                end += 1
            if held[0] and docs[start] != doc:
                yield doc, held, kind
                held = [[] for _ in names]
            doc = docs[start]
            for into, column in zip(held, columns):
                into.extend(column[start:end])
            start = end
    if held[0]:
        yield doc, held, kind


def _linked(doc, firsts: list, pairs: list[tuple[int, int]]) -> list[tuple]:
    """The chains of a document with each other one, given the first holder of each match and its places in both."""
    by: dict = {}
    for first, pair in zip(firsts, pairs):
        if first != doc:
            by.setdefault(first, set()).add(pair)
    out = []
    for first, matches in sorted(by.items()):
        if len(matches) > 1:  # one alone spans too little
            at, at0 = (np.array(x) for x in zip(*matches))
            out += [(doc, first, *c, None, None) for c in chain(at, at0) if c[1] - c[0] + K >= REACH and c[3] - c[2] + K >= REACH]
    return out


def _first_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of the matches by single seeds, and rows (doc, key, places) of runs that need a first holder."""
    rows: list[tuple] = []
    for doc, (h, n, at, first, at0), kind in _documents(batches, ("h", "n", "at", "first", "at0")):
        rows += _linked(doc, first, list(zip(at, at0)))
        names = np.array(first, object) if kind not in (pa.int32(), pa.int64()) else np.array(first)
        where = np.array(at)
        for key, i, j in runs(np.array(h, "i8").view("u8"), np.array(n), where, names, np.array(at0)):
            rows.append((doc, None, None, None, None, None, at[i:j], None, key, at[i]))
        if len(rows) > 10_000:
            yield _rows(rows, kind)
            rows = []
    if rows:
        yield _rows(rows, kind)


def _run_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of the matches by runs of seeds."""
    rows: list[tuple] = []
    for doc, (first, m, m0), kind in _documents(batches, ("first", "m", "m0")):
        every = [(f, pair) for f, x, x0 in zip(first, m, m0) for pair in zip(x, x0)]
        rows += _linked(doc, [f for f, _ in every], [pair for _, pair in every])
        if len(rows) > 10_000:
            yield _rows(rows, kind)
            rows = []
    if rows:
        yield _rows(rows, kind)


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["doc", "first", "a", "b", "a0", "b0", "m", "m0", "key", "at"]
    kinds = [kind] * 2 + [pa.int32()] * 4 + [pa.list_(pa.int32())] * 2 + [pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _walk(x: list, y: list, i: int, j: int, skip: int = SKIP) -> tuple[int, int, int, int]:
    """From x[i], y[j] on: (agreeing words, words passed in x, in y, steps), to the last place where they agree."""
    n, m, same, steps = len(x), len(y), 0, 0
    best = (0, i, j, 0)
    while i < n and j < m:
        if x[i] == y[j]:
            i, j, same, steps = i + 1, j + 1, same + 1, steps + 1
            continue
        best = (same, i, j, steps)
        hop = None
        for t in range(1, 2 * skip + 1):
            for d in sorted(range(max(0, t - skip), min(t, skip) + 1), key=lambda d, t=t: abs(2 * d - t)):
                p, q = i + d, j + t - d
                if p + 2 < n and q + 2 < m and x[p] == y[q] and x[p + 1] == y[q + 1] and x[p + 2] == y[q + 2]:
                    hop = (p, q, max(d, t - d))
                    break
            if hop:
                break
        if hop is None:
            return best
        i, j, steps = hop[0], hop[1], steps + hop[2]
    return (same, i, j, steps)


def align(x: list, y: list, i: int, j: int, least: int = 0, least0: int = 0) -> tuple[int, int, int, int, int, int]:
    """(start, end in x; start, end in y; agreeing words; steps) of the passage through x[i] = y[j], which starts at
    `least` and `least0` or later."""
    f = _walk(x, y, i, j)
    g = _walk(x[least:i][::-1], y[least0:j][::-1], 0, 0)
    return i - g[1], f[1], j - g[2], f[2], f[0] + g[0], f[3] + g[3]


def stretches(x: list, y: list, matches: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """The passages through a chain's matches, as align() gives them; none overlaps another in either text."""
    e = e0 = 0
    for i, j in matches:
        if i < e or j < e0 or i + K > len(x) or j + K > len(y) or x[i : i + K] != y[j : j + K]:
            continue
        found = align(x, y, i, j, e, e0)
        e, e0 = found[1], found[3]
        yield found


def _verified(least: int, similar: float):
    """The passages of each chain, given a segment of both texts; and an `open` row where one comes so near to the edge of a
    segment that was cut there that more words could change it, with the word up to which it is known on that side."""
    near = SKIP + 3  # words that _walk looks ahead

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = ("c", "doc", "first", "m", "m0", "s", "s0", "n", "n0", "p", "q")
            for c, doc, first, m, m0, s, s0, n, n0, p, q in zip(*[batch.column(k).to_pylist() for k in columns]):
                x, y = p.encode("utf-8", "surrogatepass").split(), q.encode("utf-8", "surrogatepass").split()
                found = list(stretches(x, y, [(a - s, a0 - s0) for a, a0 in zip(m, m0)]))
                low, low0 = (near if s else 0), (near if s0 else 0)
                high, high0 = len(x) - near * (len(x) == n), len(y) - near * (len(y) == n0)  # a shorter one is the text's end
                left = [s + b for b, _, b0, _, _, _ in found if b < low or b0 < low0]
                right = [s + e for _, e, _, e0, _, _ in found if e > high or e0 > high0]
                if left or right:
                    rows.append((c, doc, min(left, default=None), max(right, default=None), None, None, None, None, None, True))
                for b, e, b0, e0, same, steps in found:
                    if min(e - b, e0 - b0) >= least and same >= similar * steps:
                        rows.append((c, doc, s + b, s + e, first, s0 + b0, s0 + e0, same, same / steps, False))
            kind = batch.column("doc").type
            kinds = [pa.int64(), kind, pa.int64(), pa.int64(), kind, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            names = ["c", "doc_id", "start_word", "end_word", "first_doc_id", "first_start", "first_end", "same_words", "similarity", "open"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 10, kinds)], names)

    return run


def _aligned(chains: DataFrame, docs: DataFrame, margin: int, least: int, similar: float) -> DataFrame:
    """_verified on the words of each chain and `margin` more on either side."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    edge = lambda c: F.greatest(F.lit(0), F.col(c) - margin)
    size = lambda a, b: (F.col(b) + K + margin - edge(a)).cast("int")
    span = lambda side, doc, a, b: F.struct(F.lit(side).alias("side"), F.col(doc).alias("id"), edge(a).alias("s"), size(a, b).alias("n"))
    sides = chains.select("c", F.explode(F.array(span(0, "doc", "a", "b"), span(1, "first", "a0", "b0"))).alias("x")).select("c", "x.*")
    parts = sides.join(docs, sides["id"] == docs["doc_id"])
    parts = parts.select("c", "side", F.array_join(F.slice(words(F.col("text")), F.col("s") + 1, F.col("n")), " ").alias("t"))
    # Two segments a chain (more if rows share a doc_id) meet by the chain's hash.
    text = lambda side: F.collect_set(F.when(F.col("side") == side, F.col("t")))
    pairs = parts.groupBy("c").agg(text(0).alias("p"), text(1).alias("q"))
    both = chains.join(pairs, "c").withColumn("p", F.explode("p")).withColumn("q", F.explode("q"))
    both = both.select("c", "doc", "first", "m", "m0", edge("a").alias("s"), edge("a0").alias("s0"), size("a", "b").alias("n"), size("a0", "b0").alias("n0"), "p", "q")
    return both.mapInArrow(_verified(least, similar), f"c long, doc_id {kind}, start_word long, end_word long, first_doc_id {kind}, first_start long, first_end long, same_words long, similarity double, open boolean")


def _outer(found: DataFrame) -> DataFrame:
    """The passages that lie in no other one of the same two documents."""
    o, k = found.alias("o"), found.alias("k")
    same = (F.col("o.doc_id") == F.col("k.doc_id")) & (F.col("o.first_doc_id") == F.col("k.first_doc_id"))
    starts, ends = ("start_word", "first_start"), ("end_word", "first_end")
    for c in starts:
        same &= F.col(f"k.{c}") <= F.col(f"o.{c}")
    for c in ends:
        same &= F.col(f"k.{c}") >= F.col(f"o.{c}")
    larger = sum((F.col(f"k.{e}") - F.col(f"k.{b}") for b, e in zip(starts, ends)), F.lit(0)) > sum((F.col(f"o.{e}") - F.col(f"o.{b}") for b, e in zip(starts, ends)), F.lit(0))
    return o.join(k, same & larger, "left_anti")


def repeats(docs: DataFrame, least: int = LEAST, similar: float = SIMILAR) -> DataFrame:
    """One row for each passage that a document shares with the first document that has it: doc_id, start_word,
    end_word, first_doc_id, first_start, first_end (word places, ends exclusive), same_words, similarity."""
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    seeds = cut(docs.mapInArrow(_seeds, f"h long, doc {kind}, at int, n int"), "all-seeds")
    held = seeds.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first != last").select("h", "first")
    # Written first: a join of two plain shuffles is one that Spark can split where a seed is frequent.
    held = cut(held, "held")
    met = cut(seeds.join(held, "h"), "seeds")
    discard(seeds)
    discard(held)
    where = cut(met.filter("doc = first").groupBy("h").agg(F.min("at").alias("at0")), "first")
    matches = met.join(where, "h").select("h", "doc", "n", "at", "first", "at0")
    matches = matches.repartition("doc").sortWithinPartitions("doc", "at")
    schema = f"doc {kind}, first {kind}, a int, b int, a0 int, b0 int, m array<int>, m0 array<int>, key long, at int"
    found = cut(matches.mapInArrow(_first_chains, schema), "chains")
    discard(met)
    discard(where)
    keys = found.filter("key is not null").select("key", "doc", "at", "m")
    holder = keys.groupBy("key").agg(F.min(F.struct("doc", "at", "m")).alias("x"), F.max("doc").alias("last")).filter("x.doc != last")
    run = keys.join(cut(holder.select("key", F.col("x.doc").alias("first"), F.col("x.m").alias("m0")), "runs"), "key").filter("doc != first")
    run = run.select("doc", "at", "first", "m", "m0").repartition("doc").sortWithinPartitions("doc", "at")
    more = cut(run.mapInArrow(_run_chains, schema), "run-chains")
    chains = found.filter("key is null").union(more).drop("key", "at").distinct()
    chains = chains.withColumn("c", F.xxhash64(*chains.columns))
    # Where a passage reaches the edge of its segments, the chain is aligned again with more words around it; but not where
    # another passage of the document goes on beyond that edge: its words are found already.
    done, margin, texts = None, MARGIN, docs
    while True:
        aligned = cut(_aligned(chains, texts, margin, least, similar), "aligned")
        found = aligned.filter("not open").drop("open")
        known = found.select(F.col("doc_id").alias("doc"), F.col("start_word").alias("x"), F.col("end_word").alias("y"))
        if done is not None:
            known = known.union(done.select(F.col("doc_id").alias("doc"), F.col("start_word").alias("x"), F.col("end_word").alias("y")))
        known = known.distinct()
        edges = aligned.filter("open").select("c", F.col("doc_id").alias("doc"), F.explode(F.array(F.struct(F.col("start_word").alias("w"), (F.col("start_word") - SKIP).alias("v")), F.struct(F.col("end_word").alias("w"), (F.col("end_word") + SKIP).alias("v")))).alias("p"))
        edges = edges.select("c", "doc", "p.*").filter("w is not null").alias("o")
        beyond = (F.col("o.doc") == F.col("k.doc")) & (F.col("k.x") <= F.least("o.w", F.greatest("o.v", F.lit(0)))) & (F.col("k.y") >= F.greatest("o.w", "o.v"))
        again = cut(edges.join(known.alias("k"), beyond, "left_anti").select("c").distinct(), "again")
        found = found.join(again, "c", "left_anti").drop("c")
        done = found if done is None else done.union(found)
        if again.isEmpty():
            return _outer(cut(done.distinct(), "passages"))
        chains, margin = cut(chains.join(again, "c", "left_semi"), "open"), margin * WIDER
        # Few documents: Spark knows the size of the written ids, and needn't shuffle texts to pick theirs.
        ids = cut(chains.select(F.col("doc").alias("doc_id")).union(chains.select("first")).distinct(), "open-ids")
        texts = docs.join(ids, "doc_id", "left_semi")
