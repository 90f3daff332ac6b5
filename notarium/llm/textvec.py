"""Whole-batch text scanning with numpy: words, 64-bit hashes and shingles of many texts at once.

Nothing here loops over characters or words in Python.  A batch is cut into blocks of whole documents of about
BLOCK bytes, so that memory is bounded by the block (or by the longest single document), never by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 2 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _BASE_INVERSE)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A finaliser of 64-bit values (splitmix)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def blocks(column: pa.Array | pa.ChunkedArray, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in these bytes) of runs of whole texts; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + block, "right")) - 1)
        last = min(last, len(column), first + 20_000)
        yield first, raw[offs[first] : offs[last]], (offs[first : last + 1] - offs[first]).astype(np.int64)
        first = last


def word_spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, cut at document ends; and the first word of each document."""
    n = len(inside)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends_at = offs[1:][offs[1:] > 0] - 1
    after[ends_at] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes, equal hash."""
    n = len(raw)
    power, inverse = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[raw] * power[:n], out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(word: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words within each document, and the first run of each document.

    A document of fewer than k words, but at least one, has a single run: all of it.
    """
    count = np.diff(first)
    runs = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    at = np.zeros(len(runs) + 1, np.int64)
    np.cumsum(runs, out=at[1:])
    pos = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], runs)
    short = np.repeat(np.minimum(count, k), runs)
    out = np.zeros(at[-1], np.uint64)
    padded = np.concatenate([word, np.zeros(k, np.uint64)])
    any_short = bool((short < k).any())
    with np.errstate(over="ignore"):
        for j in range(k):
            value = padded[pos + j]
            if any_short:
                value = np.where(j < short, value, np.uint64(0))
            out = out * np.uint64(0xC2B2AE3D27D4EB4F) + value
        return mix(out + short.astype(np.uint64)), at
