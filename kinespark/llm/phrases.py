"""Phrase collocations from depth-limited count tries.

Each task turns its texts into count tries of bounded size: level by level, a node is a distinct (parent, word), so that a
trie of `depth` words is a few sorted arrays; the language is its first step. A trie is serialised in order, a node before
its children and siblings by their words' bytes, and cut into blocks that begin with the path to their first node. The
blocks' first nodes give prefix ranges that hold about equally many nodes; blocks are cut at the ranges' edges, and the
sorted pieces of a range are merged, which sums equal nodes. Of the merged trie the nodes that count `least` or more are
kept: with a phrase all its parts are. Walking down to a node collects the counts of its left parts, f(first k words), and
following its suffix links (the node without the first word) those of its right parts; both are joins of a level with
the one above it.

A phrase lies in a longer one exactly if it lies in one that is longer by one word and at least as frequent, so a
phrase's children and the nodes whose suffix link it is decide whether it is dropped.

Defined results: a null or empty text has no words; a null language is `und`; words are compared by their bytes after A-Z
are lower-cased; repeated rows count again; equal scores go by count and then by the phrase's bytes; very long texts are read
whole, and a task's memory is a small multiple of the longest; an empty table gives an empty result; columns beyond text and lang
are ignored.

Scale: texts are read once and not shuffled. Tries go to the shared folder, about 3 bytes a node, and are shuffled once;
a hot word or phrase is one node of a trie, however often it occurs. Ranges are as many as it takes to keep them
near `part` nodes, up to `most_ranges`; beyond that a range's phrases are dealt to as many groups by their hash, so that a
group's memory stays bounded. The ranges' edges are the one thing that goes through the driver.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard

DEPTH, LEAST, TOP = 4, 30, 2000
#: A phrase is dropped where WITHIN hundredths of its occurrences lie in a longer one; scores are floor(UNIT a / (l + r)).
WITHIN, UNIT = 80, 2000000
#: Bytes of text that are split at once; words of a task's trie; nodes of a block, of a range, and ranges; groups that a
#: language's first phrases are chosen in.
SLICE, WORDS, BLOCK, PART, MOST_RANGES, GROUPS = 1 << 19, 1 << 18, 1 << 15, 1 << 20, 4096, 64
UNKNOWN = "und"
SPACES, BREAKS = b" \t", b".,;:!?\n\x0b\f\r"


class Trie:
    """A trie in order: for each node its depth, its last step (an index into `names`, which is sorted) and its count."""

    def __init__(self, depth, step, count, names: pa.Array):
        self.depth, self.step, self.count, self.names = depth, step, count, names

    def above(self):
        """For each node (row) and depth (column) the node on its path, -1 below it."""
        import numpy as np

        out = np.full((len(self.depth), int(self.depth.max()) + 1), -1, "i8")
        at = np.arange(len(self.depth))
        for d in range(out.shape[1]):
            last = np.maximum.accumulate(np.where(self.depth == d, at, -1))
            out[:, d] = np.where(self.depth >= d, last, -1)
        return out

    def path(self, above, node: int) -> tuple[bytes, ...]:
        return tuple(self.names[int(self.step[x])].as_py() for x in above[node] if x >= 0)

    def part(self, above, at: int, end: int, keep=None) -> bytes:
        """The nodes at <= node < end, of them `keep` if it is given, serialised; those on their paths come with a count of 0."""
        import numpy as np

        path = above[at][: int(self.depth[at])]
        held = np.concatenate([path, np.arange(at, end)])
        count = self.count[held]
        count[: len(path)] = 0
        if keep is not None:
            count[len(path) :][~keep[at:end]] = 0
            on_path = np.concatenate([above[at:end][keep[at:end]].ravel(), path])
            held, count = held[fits := np.isin(held, on_path)], count[fits]
        return _written(self.depth[held], self.step[held], count, self.names)


def _narrow(values):
    """Numbers from 0 up, as the narrowest unsigned integers that hold them."""
    import numpy as np

    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _written(depth, step, count, names: pa.Array) -> bytes:
    """A trie in order with the names that it uses: sizes and widths, then the arrays one after another, compressed."""
    import numpy as np

    used, step = np.unique(step, return_inverse=True)
    held = names.take(pa.array(used))
    ends = np.frombuffer(held.buffers()[1], "i8", len(held) + 1)
    arrays = [_narrow(count), _narrow(step), _narrow(np.diff(ends)), depth]
    raw = b"".join([*[x.tobytes() for x in arrays], bytes(held.buffers()[2] or b"")[: ends[-1]]])
    return np.array([len(raw), *[n for x in arrays for n in (len(x), x.itemsize)]], "i8").tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _read(part: bytes) -> Trie:
    import numpy as np

    size, *shapes = (int(x) for x in np.frombuffer(part, "i8", 9))
    raw, at, out = pa.decompress(part[72:], size, "zstd", asbytes=True), 0, []
    for n, width in zip(shapes[::2], shapes[1::2]):
        out.append(np.frombuffer(raw, f"u{width}", n, at))
        at += out[-1].nbytes
    count, step, lengths, depth = out
    ends = np.concatenate([[0], np.cumsum(lengths, dtype="i8")])
    names = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(raw[at:])])
    return Trie(depth, step.astype("i4"), count.astype("i8"), names)


def _ordered(names: pa.Array):
    """(the distinct names in the order of their bytes, for each of `names` its place there)."""
    import numpy as np
    import pyarrow.compute as pc

    coded = names.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), "i8")
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


def _summed(key, count):
    """(distinct keys in order, their sums, for each key its place). Sorted runs, one after another, are merged."""
    import numpy as np

    order = np.argsort(key, kind="stable")
    held = key[order]
    fresh = np.concatenate([[True], held[1:] != held[:-1]]) if len(held) else np.zeros(0, bool)
    sums = np.add.reduceat(count[order], np.flatnonzero(fresh)) if len(held) else np.zeros(0, "i8")
    place = np.empty(len(key), "i8")
    place[order] = np.cumsum(fresh) - 1
    return held[fresh], sums, place


def _in_order(levels: list[tuple], names: pa.Array) -> tuple:
    """One trie of levels (parent's place in the level above, step, count), each sorted by parent and step; and each node's parent."""
    import numpy as np

    sizes = [np.ones(len(x[0]), "i8") for x in levels]
    for d in range(len(levels) - 1, 0, -1):
        np.add.at(sizes[d - 1], levels[d][0], sizes[d])
    depth, step, count, over = (np.zeros(sum(map(len, sizes)), t) for t in ("u1", "i4", "i8", "i4"))
    at = np.zeros(1, "i8")
    for d, (parent, steps, counts) in enumerate(levels):
        before = np.concatenate([[0], np.cumsum(sizes[d])])
        eldest = np.searchsorted(parent, np.arange(len(at)))
        up = at[parent]
        at = up + (d > 0) + before[:-1] - before[eldest[parent]]
        depth[at], step[at], count[at], over[at] = d, steps, counts, up
    return Trie(depth, step, count, names), over


def _grown(langs, words, pieces, names: pa.Array, depth: int) -> tuple:
    """_in_order of a run of words: for each its language and word (places in `names`) and its piece, never falling."""
    import numpy as np

    n, size = len(words), len(names)
    steps, counts, node = _summed(langs, np.ones(n, "i8"))
    levels, at = [(np.zeros(len(steps), "i8"), steps, counts)], np.arange(n)
    for d in range(1, depth + 1):
        fits = at + d - 1 < n
        at, node = at[fits], node[fits]
        fits = pieces[at + d - 1] == pieces[at]
        at, node = at[fits], node[fits]
        keys, counts, node = _summed(node * size + words[at + d - 1], np.ones(len(at), "i8"))
        levels.append((keys // size, keys % size, counts))
    return _in_order(levels, names)


def _words(texts: pa.Array) -> Iterator[tuple]:
    """(first row, each word's row from there, each word's piece, the words) of slices of a text column."""
    import numpy as np

    from . import automaton as A

    kind = np.zeros(256, "u1")
    kind[list(SPACES)], kind[list(BREAKS)] = 1, 2
    for row, last, offsets, data in A.slices(texts, SLICE):
        kinds = kind[data]
        starts, ends = A.runs(kinds == 0, offsets)
        owner = np.repeat(np.arange(last - row), np.diff(np.searchsorted(starts, offsets)))
        breaks = np.cumsum(kinds == 2)
        edges = np.concatenate([[0], np.cumsum(ends - starts)])
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges.astype("i8")), pa.py_buffer(A.LOWER[data[kinds == 0]])])
        yield row, owner, (breaks[starts] if len(starts) else starts) + owner, held


def _tries(batches: Iterator[pa.RecordBatch], depth: int, words: int) -> Iterator[tuple]:
    import numpy as np

    held, size = [], 0

    def grown() -> tuple:
        sizes = np.cumsum([len(w) for _, _, w, _ in held])
        names, place = _ordered(pa.concat_arrays([w for _, _, w, _ in held] + [x for *_, x in held]))
        langs, at = [], sizes[-1]
        for owner, *_, own in held:
            langs.append(place[at + owner])
            at += len(own)
        pieces, last = [], 0
        for _, piece, _, _ in held:
            pieces.append(piece + last)
            last = int(pieces[-1][-1]) + 1
        return _grown(np.concatenate(langs), place[: sizes[-1]], np.concatenate(pieces), names, depth)

    for batch in batches:
        langs = batch.column("lang").cast(pa.large_binary()).fill_null(UNKNOWN.encode())
        for row, owner, piece, found in _words(batch.column("text")):
            if len(found):
                held.append((owner, piece, found, langs.slice(row, int(owner[-1]) + 1)))
                size += len(found)
            if size >= words:
                yield grown()
                held, size = [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield grown()


def tries(docs: DataFrame, depth: int = DEPTH, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """(first, n, part): blocks of the tasks' tries, the path to each one's first node, and its number of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np

        for trie, over in _tries(batches, depth, words):
            # Tries are much alike: the first block's length is drawn by content, so that their blocks begin at different places.
            drawn = zlib.crc32(np.ascontiguousarray(trie.step)) % block
            for at, end in pairwise([0, *range(drawn + 1, len(trie.depth), block), len(trie.depth)]):
                path = []
                for _ in range(trie.depth[at]):
                    path.insert(0, int(over[path[0]] if path else over[at]))
                held = np.concatenate([np.array(path, "i8"), np.arange(at, end)])
                count = trie.count[held]
                count[: len(path)] = 0
                first = [trie.names[int(trie.step[x])].as_py() for x in (*path, at)]
                made = [pa.array([first], pa.list_(pa.binary())), pa.array([len(held) - len(path)], pa.int64()), pa.array([_written(trie.depth[held], trie.step[held], count, trie.names)], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, ["first", "n", "part"])

    return docs.select("text", "lang").mapInArrow(run, "first array<binary>, n long, part binary")


def _ranged(edges: list[tuple[bytes, ...]], groups: int):
    """Cuts blocks at the edges of ranges, and deals the nodes of a range to groups by the hash of their path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np

        for batch in batches:
            for part in batch.column("part").to_pylist():
                trie = _read(part)
                above, n = trie.above(), len(trie.depth)
                own = int(np.argmax(trie.count > 0))  # a block's nodes; those before them are on the first one's path
                path = lambda k: trie.path(above, k)  # noqa: B023, E731
                low, high = bisect_right(edges, path(own)), bisect_right(edges, path(n - 1))
                at = [own, *[bisect_left(range(n), e, own, key=path) for e in edges[low:high]], n]
                if groups > 1:
                    marks = np.array([zlib.crc32(x) for x in trie.names.to_pylist()], "u8")[trie.step]
                    mark = np.zeros(n, "u8")
                    for d in range(above.shape[1]):
                        mark = np.where(above[:, d] >= 0, (mark + marks[above[:, d]]) * np.uint64(0x9E3779B97F4A7C15), mark)
                    mark = (mark >> np.uint64(33)) % np.uint64(groups)
                for k in range(len(at) - 1):
                    begin, end = max(at[k], own), at[k + 1]
                    for g in range(groups if begin < end else 0):
                        keep = mark == g if groups > 1 else None
                        if keep is None or keep[begin:end].any():
                            yield pa.RecordBatch.from_arrays([pa.array([low + k], pa.int32()), pa.array([g], pa.int32()), pa.array([trie.part(above, begin, end, keep)], pa.binary())], ["range", "deal", "part"])

    return run


def _merged(least: int):
    """Merges the sorted pieces of a range; gives its nodes that count at least `least`, and languages whatever they count."""

    def run(rows: pa.Table) -> pa.Table:
        import numpy as np

        tries = [_read(x) for x in rows["part"].to_pylist()]
        names, place = _ordered(pa.concat_arrays([t.names for t in tries]))
        first, base, steps, parents = 0, 0, [], []
        for t in tries:
            steps.append(place[base + t.step])
            above = t.above()
            parent = above[np.arange(len(t.depth)), np.maximum(t.depth.astype("i8") - 1, 0)]
            parents.append(parent + first)
            first, base = first + len(t.depth), base + len(t.names)
        depth, step, count, parent = np.concatenate([t.depth for t in tries]), np.concatenate(steps), np.concatenate([t.count for t in tries]), np.concatenate(parents)
        node, levels = np.zeros(len(depth), "i8"), []
        for d in range(int(depth.max()) + 1):
            at = np.flatnonzero(depth == d)
            keys, sums, node[at] = _summed((node[parent[at]] if d else 0) * len(names) + step[at], count[at])
            levels.append((keys // len(names), keys % len(names), sums))
        out = []
        for d in range(len(levels)):
            kept = np.flatnonzero(levels[d][2] >= (least if d else 1))
            at, words = kept, []
            for k in range(d, 0, -1):
                words.append(levels[k][1][at])
                at = levels[k][0][at]
            words = [names.take(pa.array(x)).to_pylist() for x in reversed(words)]
            phrases = [b" ".join(x) for x in zip(*words)] if d else [b""] * len(kept)
            made = [names.take(pa.array(levels[0][1][at])).cast(pa.binary()), pa.array(np.full(len(kept), d), pa.int32()), pa.array(phrases, pa.binary()), pa.array(levels[d][2][kept], pa.int64())]
            out.append(pa.table(made, names=["lang", "depth", "phrase", "f"]))
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(out)

    return run


def counts(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, words: int = WORDS, block: int = BLOCK, part: int = PART, most_ranges: int = MOST_RANGES) -> DataFrame:
    """(lang, depth, phrase, f): phrases of up to `depth` words that occur `least` times or more; depth 0 is all words of a language."""
    held = cut(tries(docs, depth, words, block), "tries")
    nodes = held.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, min(most_ranges, -(-nodes // part)))
    groups = max(1, -(-nodes // (ranges * part)))
    # Blocks have equally many nodes, so that their first nodes stand for the nodes' distribution; a hash picks some.
    firsts = held.select("first").orderBy(F.xxhash64("first"), "first").limit(20 * ranges).collect() if ranges > 1 else []
    firsts = sorted(tuple(bytes(x) for x in r["first"]) for r in firsts)
    edges = sorted({firsts[len(firsts) * k // ranges] for k in range(1, ranges)} - {firsts[0]}) if firsts else []
    dealt = held.select("part").mapInArrow(_ranged(edges, groups), "range int, deal int, part binary")
    merged = dealt.groupBy("range", "deal").applyInArrow(_merged(least), "lang binary, depth int, phrase binary, f long")
    out = cut(merged.select(F.col("lang").cast("string").alias("lang"), "depth", F.col("phrase").cast("string").alias("phrase"), "f"), "phrases")
    discard(held)
    return out


def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, top: int = TOP, within: int = WITHIN, **sizes) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `top` phrases of 2 to `depth` words."""
    held = counts(docs, depth, least, **sizes)
    none = F.array().cast("array<bigint>")
    level = held.filter("depth = 1").select("lang", "phrase", "f", none.alias("left"), none.alias("right"))
    found, longer = None, None
    for d in range(2, depth + 1):
        own = held.filter(F.col("depth") == d).select("lang", "phrase", "f", F.substring_index("phrase", " ", d - 1).alias("parent"), F.substring_index("phrase", " ", 1 - d).alias("link"))
        above = level.select("lang", F.col("phrase").alias("parent"), F.concat("left", F.array("f")).alias("left"))
        linked = level.select("lang", F.col("phrase").alias("link"), F.concat(F.array("f"), "right").alias("right"))
        level = own.join(above, ["lang", "parent"]).join(linked, ["lang", "link"]).select("lang", "phrase", "f", "left", "right")
        found = level if found is None else found.union(level)
        if d > 2:
            for c in ("parent", "link"):
                part = own.select("lang", F.col(c).alias("phrase"), "f")
                longer = part if longer is None else longer.union(part)
    if longer is not None:
        longest = longer.groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
        found = found.join(longest, ["lang", "phrase"], "left").filter(F.col("_longer").isNull() | (_exact("_longer") * 100 < _exact("f") * within)).drop("_longer")
    sides = F.arrays_zip(F.col("left").alias("l"), F.col("right").alias("r"))
    score = lambda x: F.call_function("div", _exact("f") * UNIT, _exact(x["l"]) + _exact(x["r"]))
    lowest = F.array_min(F.transform(sides, lambda x, k: F.struct(score(x).alias("score"), k.alias("k"), x["l"].alias("l"), x["r"].alias("r"))))
    found = found.select("lang", "phrase", F.col("f").alias("a"), lowest.alias("_cut")).select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    best = (F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    # A language's best are among the best of its groups, so that no task sorts a whole language.
    group = F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))
    found = found.withColumn("_group", group).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_group").orderBy(*best))).filter(F.col("_rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")).filter(F.col("rank") <= top)
    whole = held.filter("depth = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return found.join(whole, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def sql(least: int = LEAST, top: int = TOP, within: int = WITHIN) -> str:
    """The same for phrases of up to four words, in DuckDB's SQL."""
    row = lambda d: f"SELECT lang, array_to_string(w[i:i+{d - 1}], ' ') AS p, {d} AS d FROM t, unnest(range(1, len(w) - {d - 2})) AS x(i)"
    part = lambda a, b: f"array_to_string(string_split(p, ' ')[{a}:{b}], ' ')"
    return f"""WITH pieces AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS s FROM documents),
t AS (SELECT lang, regexp_extract_all(s, '[^\\x20\\x09]+') AS w FROM pieces),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM t GROUP BY lang),
f AS (SELECT lang, p, d, count(*) AS f FROM ({" UNION ALL ".join(row(d) for d in (1, 2, 3, 4))}) GROUP BY lang, p, d HAVING count(*) >= {least}),
cuts AS (SELECT lang, p, d, f AS a, k, {part(1, "k")} AS x, {part("k + 1", "d")} AS y FROM f, unnest(range(1, d)) AS c(k)),
scored AS (SELECT c.*, u.f AS l, v.f AS r, (2000000::HUGEINT * a) // (u.f + v.f) AS score FROM cuts c JOIN f u ON u.lang = c.lang AND u.p = x JOIN f v ON v.lang = c.lang AND v.p = y),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
held AS (SELECT lang, {part("b", "b + e - 1")} AS p, max(f) AS f FROM f, unnest(range(2, d)) AS y(e), unnest(range(1, d - e + 2)) AS z(b) GROUP BY 1, 2),
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.p) AS rank FROM lowest s LEFT JOIN held h ON h.lang = s.lang AND h.p = s.p WHERE h.f IS NULL OR 100 * h.f < {within} * a)
SELECT lang, rank, p AS phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= {top}"""
