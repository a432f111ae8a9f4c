"""Words of Arrow text batches as 64-bit hashes, computed on whole batches with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes hashed at a time; bounds the temporary arrays.
CHUNK = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers, one per seed (the splitmix finaliser)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int64)
    else:
        offsets = np.frombuffer(column.buffers()[1], np.int32).astype(np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words in text order: where each starts and ends, its hash, and each text's first word."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    prefixes: np.ndarray | None
    bounds: np.ndarray  # word numbers at which texts begin, and the number of words


def words_of(data: np.ndarray, offsets: np.ndarray, between: np.ndarray, prefix: int = 0) -> Words:
    """Runs of bytes not in ``between`` (a table of 256), never across texts.

    ``prefix`` > 0 also hashes the first so many bytes of each word.
    """
    inside = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.zeros(len(starts), np.uint64)
    prefixes = np.zeros(len(starts), np.uint64) if prefix else None
    lengths = ends - starts
    total = np.cumsum(lengths)
    at = 0
    while at < len(starts):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + CHUNK)))
        size = lengths[at:to]
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(begin, size)
        taken = np.repeat(starts[at:to], size) + place
        powers = np.cumprod(np.full(int(size.max()) + 1, _STEP | np.uint64(1)))
        value = (data[taken].astype(np.uint64) + np.uint64(1)) * powers[place]
        hashes[at:to] = mix(np.add.reduceat(value, begin) + size.astype(np.uint64))
        if prefix:
            value[place >= prefix] = 0
            prefixes[at:to] = mix(np.add.reduceat(value, begin), 1)
        at = to
    return Words(starts, ends, hashes, prefixes, np.searchsorted(starts, offsets))
