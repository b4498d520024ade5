"""Array code over the UTF-8 bytes of a batch of texts: words, hashes and n-grams without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.random.default_rng(20240229).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = np.random.default_rng(20240301).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) <= n:
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        size = max(n + 1, 1 << 20)
        for key, x in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits look random."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 places where its rows begin and end; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes, or one longer row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


def parts(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) for each range of slices()."""
    data, offsets = utf8(column)
    for a, b in slices(offsets, most):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word `[^\\x20\\x09-\\x0D]+` (or run of bytes that are not apart), and where each row's words begin in those arrays (n + 1 places)."""
    inside = ~apart[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def spelt(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeStringArray:
    """The bytes of spans in rising order that do not overlap, as strings."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    inside = np.cumsum(inside, dtype=np.int8)[:-1].astype(bool)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside]))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal spans have equal hashes wherever they stand."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP[15])


def shingles(hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of so many words within a row, and where each row's windows begin (n + 1 places).

    A row with fewer words (but at least one) has one window, all of them.
    """
    counts = np.diff(firsts)
    short = (counts > 0) & (counts < width)
    sizes = np.where(short, 1, np.maximum(counts - width + 1, 0))
    places = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(places[-1], np.uint64)
    if len(hashes) >= width:
        sums = np.zeros(len(hashes) - width + 1, np.uint64)
        for j in range(width):
            sums += hashes[j : len(hashes) - width + 1 + j] * _STEP[j]
        rows = np.flatnonzero(counts >= width)
        take = np.repeat(firsts[rows] - places[rows], sizes[rows]) + _ranges(places[rows], sizes[rows])
        out[_ranges(places[rows], sizes[rows])] = mix(sums[take])
    for i in np.flatnonzero(short):
        part = hashes[firsts[i] : firsts[i + 1]]
        with np.errstate(over="ignore"):
            whole = np.uint64(len(part)) * _STEP[14] + (part * _STEP[: len(part)]).sum(dtype=np.uint64)
        out[places[i]] = mix(np.array([whole], np.uint64))[0]
    return out, places


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then the next."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


ranges = _ranges


def distinct(values: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in rising order, and where each row's begin."""
    kept, sizes = [], np.zeros(len(places) - 1, np.int64)
    for i in range(len(sizes)):
        row = np.sort(values[places[i] : places[i + 1]])
        if len(row) > 1:
            row = row[np.concatenate([[True], row[1:] != row[:-1]])]
        kept.append(row)
        sizes[i] = len(row)
    return np.concatenate(kept) if kept else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def lists(values: np.ndarray, places: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from the flat values and the places where rows begin."""
    return pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(values, kind))
