"""JSON files that hold one array of records, read in byte ranges and written by partition.

Whether a byte of such a file lies within a string depends on all quotes before it. Each range is therefore scanned for every
state that it may begin in (outside a string, within one, within one after a backslash), which gives the state at its end
and how far the brackets' depth changes. The ranges' summaries, one row each, are put one after another on the driver; then
each range is read from its known state. A record belongs to the range that holds the comma or bracket before it, and is read
on beyond the range's end. A task holds a block and one record, whatever the file's size and wherever it has line breaks.

Defined results: elements are given as their JSON text, in no order; an empty file or array has none, and so has a file whose
top value is no array (it is left out); records of a file that breaks off within one are given up to there, the last one
as far as it goes; empty elements (`[1,,2]`) are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .stores import files, opened

#: Bytes of a range, of what is looked at at once, and of a batch of records.
SPLIT, BLOCK, BATCH = 128 << 20, 1 << 20, 4 << 20
QUOTE, SLASH, COMMA, OPEN, CLOSE = (ord(c) for c in '"\\,[]')
#: What a range may begin in: (within a string, after a backslash).
STATES = ((0, 0), (1, 0), (1, 1))


def scan(block: np.ndarray, quoted: int, escaped: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Which bytes are outside strings, how each changes the depth, and the state after the block."""
    at = np.arange(len(block))
    plain = np.maximum.accumulate(np.where(block == SLASH, -1, at))  # the last byte up to here that is no backslash
    before = np.concatenate([[-1], plain[:-1]])
    slashes = at - 1 - before + np.where(before < 0, escaped, 0)  # that stand right before a byte
    quotes = (block == QUOTE) & (slashes % 2 == 0)
    inside = np.cumsum(quotes) + quoted & 1
    outside = (inside == 0) & ~quotes
    steps = np.where(outside, np.isin(block, list(b"[{")).astype("i8") - np.isin(block, list(b"]}")), 0)
    rest = len(block) - 1 - plain[-1] + (escaped if plain[-1] < 0 else 0)
    return outside, steps, int(inside[-1]), int(rest % 2)


def _blocks(path: str, start: int, end: int | None, size: int) -> Iterator[np.ndarray]:
    store, within = opened(path)
    with store.open_input_file(within) as f:
        f.seek(start)
        while end is None or start < end:
            data = f.read(size if end is None else min(size, end - start))
            if not data:
                return
            start += len(data)
            yield np.frombuffer(data, "u1")


def summary(blocks: Iterator[np.ndarray]) -> list[tuple[int, int, int]]:
    """For each of STATES at the beginning the state at the end, and the change of depth."""
    held = [(*state, 0) for state in STATES]
    for block in blocks:
        for k, (quoted, escaped, depth) in enumerate(held):
            _, steps, quoted, escaped = scan(block, quoted, escaped)
            held[k] = (quoted, escaped, depth + int(steps.sum()))
    return held


def records(blocks: Iterator[np.ndarray], size: int, quoted: int, escaped: int, depth: int) -> Iterator[bytes]:
    """The elements whose comma or bracket before them is among the first `size` bytes."""
    at, held = 0, None
    for block in blocks:
        outside, steps, quoted, escaped = scan(block, quoted, escaped)
        depths = depth + np.cumsum(steps)
        depth = int(depths[-1])
        edges = outside & ((depths == 1) & ((block == COMMA) | (block == OPEN) & (steps == 1)) | (depths == 0) & (block == CLOSE))
        start = 0
        for k in np.flatnonzero(edges).tolist():
            if held is not None:
                yield b"".join([*held, block[start:k].tobytes()])
            if at + k >= size:
                return
            held, start = (None if block[k] == CLOSE else []), k + 1
        if held is not None:
            held.append(block[start:].tobytes())
        at += len(block)
        if at >= size and held is None:
            return
    if held is not None:
        yield b"".join(held)


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, state: tuple = ()):
        self.path, self.start, self.end, self.state = path, start, end, state


class _Source(DataSource):
    def reader(self, schema):
        return self.READER(self.options)


class _SummaryReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["root"], int(options["split"])

    def partitions(self):
        out = []
        for path, size in files(self.path):
            first = next(_blocks(path, 0, 4096, 4096)).tobytes().lstrip(b"\xef\xbb\xbf \t\r\n")
            if first[:1] == b"[":
                out += [Range(path, at, min(size, at + self.split)) for at in range(0, size, self.split)]
        return out or [Range("", 0, 0)]

    def read(self, part):
        if part.path:
            yield part.path, part.start, part.end, json.dumps(summary(_blocks(part.path, part.start, part.end, BLOCK)))


class Summaries(_Source):
    """The ranges of array files with their summaries."""

    READER = _SummaryReader

    @classmethod
    def name(cls):
        return "json_array_summaries"

    def schema(self):
        return "path string, start long, end long, states string"


class _ElementReader(DataSourceReader):
    def __init__(self, options):
        self.ranges = json.loads(options["ranges"])

    def partitions(self):
        return [Range(path, start, end, tuple(state)) for path, start, end, state in self.ranges] or [Range("", 0, 0)]

    def read(self, part):
        held, size = [], 0
        for x in records(_blocks(part.path, part.start, None, BLOCK), part.end - part.start, *part.state) if part.path else ():
            if x := x.strip():
                held.append(x)
                size += len(x)
            if size >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()).cast(pa.string())], ["value"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()).cast(pa.string())], ["value"])


class Elements(_Source):
    """The elements of array files, whose ranges and states are given."""

    READER = _ElementReader

    @classmethod
    def name(cls):
        return "json_array_elements"

    def schema(self):
        return "value string"


def elements(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(value): each element of the arrays in the files of a path, as JSON text."""
    for source in (Summaries, Elements):
        spark.dataSource.register(source)
    held = spark.read.format(Summaries.name()).option("root", path).option("split", split).load().collect()  # one row a range
    ranges, state, last = [], (0, 0, 0), None
    for r in sorted(held):
        state = state if r.path == last else (0, 0, 0)
        ranges.append((r.path, r.start, r.end, state))
        quoted, escaped, depth = json.loads(r.states)[STATES.index(state[:2])]
        state, last = (quoted, escaped, state[2] + depth), r.path
    return spark.read.format(Elements.name()).option("ranges", json.dumps(ranges)).load()


def load_array(spark: SparkSession, path: str, schema: str, split: int = SPLIT) -> DataFrame:
    """The records of arrays, elements that are no objects left out; fields that don't fit the schema are null."""
    held = elements(spark, path, split).filter(F.col("value").startswith("{"))
    return held.select(F.from_json("value", schema).alias("r")).select("r.*")


def _as_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one array, of whose records one is held back: it may be the last."""
    held, first = None, True
    for batch in batches:
        lines = []
        for x in batch.column("value").to_pylist():
            lines += ["["] * first + ([held + ","] if held is not None else [])
            held, first = x, False
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
    if not first:
        yield pa.RecordBatch.from_arrays([pa.array([held, "]"], pa.string())], ["value"])


def dump_array(df: DataFrame, path: str, indent: bool = True) -> None:
    """Writes a folder of files, each one array of records, indented by two; no task holds more than a batch."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"pretty": "true", "ignoreNullFields": "false"} if indent else {"ignoreNullFields": "false"})
    text = F.concat(F.lit("  "), F.replace(text, F.lit("\n"), F.lit("\n  "))) if indent else text
    df.select(text.alias("value")).mapInArrow(_as_arrays, "value string").write.mode("overwrite").text(path)
