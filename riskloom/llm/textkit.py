"""Vectorised word splitting and hashing over Arrow string columns.

The functions here run inside Spark tasks. They look at whole texts as UTF-8 bytes and work on
chunks of half a MB, so that the temporary arrays stay small whatever the size of an Arrow batch.
A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of every byte except the space and the control characters from tab to carriage return.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_powers = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64, kept for later calls."""
    if _powers["n"] < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out, have = np.ones(size, np.uint64), 1
            while have < size:
                step = min(have, size - have)
                out[have : have + step] = out[:step] * np.uint64(pow(base, have, 1 << 64))
                have += step
            _powers[name] = out
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


def freed() -> None:
    """Gives memory that earlier batches and stages have left free in this worker back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows as (first row, bytes, offsets); a run ends before it passes limit bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield row, buf[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


@dataclass
class Words:
    """The words of a run of texts: where they start and end, whose they are, and their hashes."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # first[d] to first[d + 1]: the words of text d


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray = SPACED, lower: bool = True) -> Words:
    n, docs = len(data), len(offs) - 1
    if lower:
        data = LOWER[data]
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = is_word[data]
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside[:n]
    before[offs[:-1]] = False
    start = np.flatnonzero(inside & ~before)
    after = inside.copy()
    after[offs[1:]] = False
    after[n] = False
    end = np.flatnonzero(inside[:n] & ~after[1:]) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start])
    doc = np.searchsorted(offs, start, "right") - 1
    return Words(start, end, doc, h, np.searchsorted(doc, np.arange(docs + 1)))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words, and where those of each text begin.

    A text of fewer words, but not none, has its whole sequence as its one shingle.
    """
    docs = len(w.first) - 1
    count = np.diff(w.first)
    full = np.maximum(count - (k - 1), (count > 0).astype(count.dtype))
    first = np.zeros(docs + 1, np.int64)
    np.cumsum(full, out=first[1:])
    out = np.zeros(first[-1], np.uint64)
    if not len(out):
        return out, first
    owner = np.repeat(np.arange(docs), full)
    at = w.first[owner] + (np.arange(len(out)) - first[owner])
    last = w.first[owner + 1] - 1
    for j in range(k):
        step = np.uint64(pow(0xA24BAED4963EE407, j + 1, 1 << 64))
        there = at + j <= last
        out += np.where(there, w.hash[np.minimum(at + j, last)] * step, np.uint64(0))
    return mix(out), first


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each run."""
    out = np.zeros(len(first), np.int64)
    if len(values) > 64 * len(first):
        parts = [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        np.cumsum([len(p) for p in parts], out=out[1:])
        return np.concatenate(parts), out
    run = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, run))
    values = values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (run[1:] != run[:-1])
    np.cumsum(np.bincount(run[new], minlength=len(first) - 1), out=out[1:])
    return values[new], out


def taken(values: np.ndarray, first: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the runs, in the order given."""
    size = np.diff(first)[runs]
    out = np.zeros(len(runs) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    at = np.repeat(first[:-1][runs] - out[:-1], size) + np.arange(out[-1])
    return values[at], out


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)
