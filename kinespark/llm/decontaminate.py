"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are normalised: lower case, each run of characters that are neither letters nor digits to one
space. An item of m characters occurs in a text if some region is within `e = floor(BUDGET * m)` edits of it. Such a
region shares at least m - q + 1 - q * e q-grams with the item on diagonals (place in the text less place in the item) at
most e apart; q is 8, 4 for items under SHORT characters and 1 for those under 4, so that this stays positive. Shared
q-grams are counted in bands of diagonals 2 (e + 1) wide that overlap by half; bands that meet the threshold are verified
by aligning the item within the band's window, a column of the alignment at a time in integers of m bits, which also
gives the region and its edits. Items without an edit to spend (under 10 characters) must stand as whole words.

Defined results: a null or empty text, and a null item or one without letters and digits, match nothing; an item that
occurs more than once in a text gives its best region (fewest edits, then first: ties) and the number of them; repeated
items count once; texts of any length are read whole; repeated rows each get their result; an empty table gives an empty
result; other columns, of whatever names, pass through `clean` and are ignored by `matches`.

Scale: documents are read once for each block of items and never shuffled; whole texts are scanned in pieces of bounded
size that overlap by more than an item. The items of a block, at most BLOCK characters, are what is sent to executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT, BUDGET, BLOCK, PIECE = 56, 0.10, 4_000_000, 1 << 20
_BITS, _ODD = 22, np.uint64(0x9E3779B97F4A7C15)
_cache: dict = {}


def _fold() -> np.ndarray:
    """For each character of the basic plane its lower case, or a space if it is neither letter nor digit."""
    if "fold" not in _cache:
        low = [(c.lower() if len(c.lower()) == 1 else c) if c.isalnum() else " " for c in map(chr, range(0x10000))]
        _cache["fold"] = np.array([ord(c) for c in low], "u4")
    return _cache["fold"]


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The normalised characters of a text and the place of each in the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = np.where(codes < 0x10000, _fold()[np.minimum(codes, 0xFFFF)], codes)
    for u in np.unique(codes[codes >= 0x10000]).tolist():
        low[codes == u] = ord(chr(u).lower()) if chr(u).isalnum() else 32
    blank = low == 32
    keep = np.flatnonzero(~(blank & np.concatenate(([True], blank[:-1])))) if len(low) else np.zeros(0, "i8")
    return low[keep], keep


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each place on; q is a power of two, and each doubling is a step."""
    h, size = codes.astype("u8") + np.uint64(1), 1
    for factor in (0x100000001B3, 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25):
        if size < q:
            h = h[:-size] * np.uint64(factor) + h[size:]
            size *= 2
    return (h ^ (h >> np.uint64(29))) * _ODD


class Index:
    """A block of items, with the q-grams of each class of lengths."""

    def __init__(self, items: list[tuple], budget: float = BUDGET):
        made = [(i, normal(t)[0]) for i, t in items]
        made = [(i, c[:-1] if len(c) and c[-1] == 32 else c) for i, c in made]
        made = [(i, c) for i, c in made if len(c)]
        self.ids, self.codes = [i for i, _ in made], [c for _, c in made]
        self.lists = [c.tolist() for c in self.codes]
        self.bits = [masks(c) for c in self.lists]
        self.m = np.array([len(c) for c in self.codes] or [0], "i8")
        self.e = (budget * self.m).astype("i8")
        self.reach = int((self.m + 4 * self.e).max()) + 8
        sizes = [8 if len(c) >= SHORT else 4 if len(c) >= 4 else 1 for c in self.codes]
        self.classes = [_Grams(self, q, [k for k, x in enumerate(sizes) if x == q]) for q in (8, 4, 1) if q in sizes]

    def regions(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(item, first diagonal) of each band that meets its item's threshold."""
        return [x for grams in self.classes for x in grams.regions(codes)]


class _Grams:
    """The q-grams of the items of one class."""

    def __init__(self, index: Index, q: int, items: list[int]):
        self.q, self.e, self.reach = q, index.e, index.reach
        self.least = np.maximum(1, index.m - q + 1 - q * index.e)
        grams = [_grams(index.codes[k], q) for k in items]
        every = np.concatenate(grams)
        item = np.repeat(np.array(items), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.start = np.unique(every[order], return_index=True)
        self.end = np.append(self.start[1:], len(every))
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.keys >> np.uint64(64 - _BITS)).astype("i8")] = True

    def regions(self, codes: np.ndarray) -> list[tuple[int, int]]:
        if len(codes) < self.q:
            return []
        grams = _grams(codes, self.q)
        at = np.flatnonzero(self.seen[(grams >> np.uint64(64 - _BITS)).astype("i8")])
        found = np.searchsorted(self.keys, grams[at])
        good = self.keys[np.minimum(found, len(self.keys) - 1)] == grams[at]
        at, found = at[good], found[good]
        sizes = self.end[found] - self.start[found]
        if not len(at):
            return []
        ends = np.cumsum(sizes)
        post = np.arange(ends[-1]) - np.repeat(ends - sizes - self.start[found], sizes)
        item = self.item[post]
        step = self.e[item] + 1
        band = (np.repeat(at, sizes) - self.place[post] + self.reach) // step
        key = item * np.int64(1 << 40) + band
        keys, n = np.unique(np.concatenate((key, key - 1)), return_counts=True)
        item = keys >> 40
        ok = n >= self.least[item]
        item, band = item[ok], keys[ok] & ((1 << 40) - 1)
        return list(zip(item.tolist(), (band * (self.e[item] + 1) - self.reach).tolist()))


def masks(item: list[int]) -> dict[int, int]:
    """For each character of an item the bits of its places."""
    out: dict[int, int] = {}
    for k, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << k
    return out


def _distances(bits: dict[int, int], m: int, text: list[int], anchored: bool) -> tuple[int, int]:
    """(fewest edits, characters of text used, the fewest of them) of the whole item against a stretch of text that ends
    there and begins anywhere, or at the text's first character if anchored. A column is two integers of m bits, so
    one step costs a few operations on them."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = bits.get(c, 0)
        down = eq | minus
        along = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(along | plus))
        less = plus & along
        if up & top:
            score += 1
        elif less & top:
            score -= 1
        up = (up << 1 | anchored) & full
        less = less << 1 & full
        plus = less | (full & ~(down | up))
        minus = up & down
        if score < best:
            best, end = score, j
    return best, end


def align(item: list[int], text: list[int], first: int, band: int, most: int, bits: dict[int, int] | None = None) -> tuple[int, int, int] | None:
    """(edits, start, end): the best region of text within `most` edits of item, in the window that the diagonals
    first - most to first + band + most reach; fewest edits, then leftmost end, then the latest start."""
    m = len(item)
    low, high = max(0, first - most), max(0, min(len(text), first + band + most + m))
    window = text[low:high]
    edits, end = _distances(masks(item) if bits is None else bits, m, window, False)
    if edits > most or not end:
        return None
    _, used = _distances(masks(item[::-1]), m, window[:end][::-1], True)
    return edits, low + end - used, low + end


def _words(item: list[int], text: list[int], first: int, before: bool, after: bool) -> list[tuple[int, int, int]]:
    """(0, start, end) where the item stands as whole words on the first two diagonals from `first`; where the text goes
    on before or after, its edges are no ends of words."""
    m, out = len(item), []
    for d in range(max(0, first), first + 2):
        left = text[d - 1] == 32 if d else not before
        right = text[d + m] == 32 if d + m < len(text) else not after
        if left and right and text[d : d + m] == item:
            out.append((0, d, d + m))
    return out


def find(index: Index, text: str | None) -> dict:
    """For each item found in a text: (edits, start, end, regions), in code points of the text."""
    found: dict = {}
    step = PIECE
    for at in range(0, max(1, len(text or "")), step):
        # A region may take more characters of the text than of its normal form: pieces overlap by four times the reach.
        piece = (text or "")[at : at + step + 4 * index.reach]
        codes, places = normal(piece)
        bands = index.regions(codes)
        text_codes = codes.tolist() if bands else []
        for k, first in bands:
            e = int(index.e[k])
            if not e:
                spots = _words(index.lists[k], text_codes, first, at > 0, at + len(piece) < len(text))
            else:
                best = align(index.lists[k], text_codes, first, 2 * (e + 1), e, index.bits[k])
                spots = [best] if best and best[2] > best[1] else []
            for edits, start, end in spots:
                found.setdefault(index.ids[k], set()).add((edits, at + int(places[start]), at + int(places[end - 1]) + 1))
    return {k: (*min(v), _apart(v)) for k, v in found.items()}


def _apart(regions: set) -> int:
    n, reach = 0, -1
    for _, start, end in sorted(regions, key=lambda x: x[1:]):
        n += start >= reach
        reach = max(reach, end)
    return n


def _index(items: tuple, budget: float) -> Index:
    if _cache.get("items") != (items, budget):
        _cache["items"], _cache["index"] = (items, budget), Index(list(items), budget)
    return _cache["index"]


def _scan(items: tuple, budget: float, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items, budget)
        for batch in batches:
            rows = [(d, k, *v) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) if t for k, v in sorted(find(index, t).items())]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [batch.column("doc_id").type, kind, *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "edits", "start", "end", "regions"])

    return run


def _blocks(benchmark: DataFrame, size: int) -> Iterator[tuple]:
    block, held = [], 0
    for item, text in benchmark.select("item_id", "text").filter("text is not null and item_id is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        if block and held + len(text) > size:
            yield tuple(block)
            block, held = [], 0
        block.append((item, text))
        held += len(text)
    yield tuple(block)


def matches(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block: int = BLOCK) -> DataFrame:
    """One row for each document and item that occurs in it: doc_id, item_id, edits, start, end, regions."""
    ids = {c: docs.schema["doc_id"].dataType.simpleString() if c == "doc_id" else benchmark.schema["item_id"].dataType.simpleString() for c in ("doc_id", "item_id")}
    schema = f"doc_id {ids['doc_id']}, item_id {ids['item_id']}, edits long, start long, end long, regions long"
    kind = pa.string() if ids["item_id"] == "string" else pa.int32() if ids["item_id"] == "int" else pa.int64()
    out = None
    for items in _blocks(benchmark, block):
        part = docs.select("doc_id", "text").mapInArrow(_scan(items, budget, kind), schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block: int = BLOCK) -> DataFrame:
    """The documents in which no item occurs, with the columns of docs. The verdict is made in place, on each row."""
    names = docs.columns
    for items in _blocks(benchmark, block):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = _index(items, budget)
            for batch in batches:
                yield batch.filter(pa.array([not (t and find(index, t)) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.select(*names)
