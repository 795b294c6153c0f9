"""Bytes of Arrow text columns as a vectorised automaton: runs of a byte class, and table-driven CRCs of many runs at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The reflected polynomial of CRC-32 (fixed value).
POLYNOMIAL = 0xEDB88320
#: Bytes that all runs advance together; of longer runs the rest is advanced run by run.
TOGETHER = 64
#: Bytes of text that are looked at at once; a longer text is looked at whole.
SLICE = 1 << 22


def _table() -> np.ndarray:
    crc = np.arange(256, dtype="u4")
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(POLYNOMIAL), crc >> 1).astype("u4")
    return crc


TABLE = _table()


def lower_case(lut: np.ndarray) -> np.ndarray:
    """A table of bytes with A-Z mapped as a-z."""
    lut[65:91] = lut[97:123]
    return lut


LOWER = lower_case(np.arange(256, dtype="u1"))


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, offsets from 0, bytes) of parts of a text column, nulls as empty texts.

    A part has up to `size` bytes, or is one longer text.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], "i8", len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", "u1")
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + size, "right")) - 1)
        yield row, last, ends[row : last + 1] - ends[row], data[ends[row] : ends[last]]
        row = last


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes `inside`, found where the class changes; none crosses a text's edge."""
    if not len(inside):
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    padded = np.concatenate([[False], inside, [False]])
    starts = padded[1:-1] & (edge[:-1] | ~padded[:-2])
    ends = padded[1:-1] & (edge[1:] | ~padded[2:])
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def advance(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The states `crc` (not inverted at the end), each advanced over the bytes of its own run."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    at, lengths, state = starts[order], lengths[order], crc[order]
    reach = np.searchsorted(-lengths, -np.arange(1, TOGETHER + 1), "right")  # runs that have a byte at each step
    for step, k in enumerate(reach):
        if not k:
            break
        state[:k] = TABLE[(state[:k] ^ data[at[:k] + step]) & 255] ^ (state[:k] >> 8)
    for k in range(np.searchsorted(-lengths, -TOGETHER, "left")):  # strictly longer runs
        rest = data[at[k] + TOGETHER : at[k] + lengths[k]].tobytes()
        state[k] = zlib.crc32(rest, int(state[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out
