"""Vectorised text helpers: Arrow string buffers seen as numpy bytes.

Words are ``[^\\x20\\x09-\\x0D]+``; UTF-8 continuation bytes never equal those separators, so
word bounds found on bytes are word bounds of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def string_array(column) -> pa.Array:
    """One contiguous ``string`` array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.fill_null("") if column.null_count else column


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 bounds of its rows (int64, from 0)."""
    a = string_array(column)
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
    bounds = np.frombuffer(a.buffers()[1], width)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if a.buffers()[2] else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def slices(batch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator:
    """Zero-copy row slices of about ``limit`` text bytes; one longer text is a slice of its own."""
    _, bounds = flat(batch.column(text))
    at, n = 0, len(bounds) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words and the n+1 bounds of each row's words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = ~SPACE[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0] = after[-1] = False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = bounds[:-1] < bounds[1:]
    before[bounds[:-1][full]] = False
    after[bounds[1:][full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each byte span, finalised; equal spans hash alike wherever they lie."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive elements of h (len(h)-k+1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(out)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Each row's (kept) words joined by one space, all rows one after another without separator.

    Returns the bytes, the n+1 row bounds and the start of each kept word in them.
    """
    if keep is not None:
        counts = np.concatenate([[0], np.cumsum(keep)])[bounds]
        starts, ends, bounds = starts[keep], ends[keep], counts
    lengths = ends - starts
    last = np.zeros(len(starts), bool)
    last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
    size = lengths + ~last
    place = np.concatenate([[0], np.cumsum(size)])
    step = np.ones(place[-1], np.int64)
    if len(starts):
        step[0] = starts[0]
        step[place[1:-1]] = starts[1:] - (starts[:-1] + size[:-1]) + 1
    source = np.cumsum(step)
    out = data[np.minimum(source, len(data) - 1)] if len(starts) else np.zeros(0, np.uint8)
    out[(place[1:] - 1)[~last]] = 32
    return out.tobytes(), place[bounds], place[:-1]
