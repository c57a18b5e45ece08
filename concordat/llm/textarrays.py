"""Texts as numpy byte arrays: word boundaries and word hashes without a Python loop per word.

A text batch is cut into slices of about half a megabyte, so that the eight-byte arrays over its
bytes stay small however long the batch is; a single longer text forms a slice of its own, which the
operators take in stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, U64), np.ones(1, U64)]

#: Bytes of ``[^\x20\x09-\x0D]`` (anything but ASCII white space).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing (digits, letters, not ASCII).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

SLICE_BYTES = 1 << 19


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets from 0; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(at) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows."""
    data, offsets = as_bytes(column)
    rows, lo = len(offsets) - 1, 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in ``inside``, and the runs before each text.

    Runs end at the end of their text; the last result has one entry more than there are texts.
    """
    is_in = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:] = is_in[:-1]
    after[:-1] = is_in[1:]
    starts = np.flatnonzero(is_in & (~before | edge[:-1]))
    ends = np.flatnonzero(is_in & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """``_BASE**i`` modulo 2**64 (or of its inverse) for i below n."""
    k = int(inverse)
    if len(_powers[k]) < n:
        size = n + (1 << 16)  # so that slices of about one size share them
        steps = np.full(size, _BASE_INVERSE if inverse else _BASE, U64)
        steps[0] = 1
        grown = np.cumprod(steps, dtype=U64)
        if n > 16 * SLICE_BYTES:  # a single very long text: not kept
            return grown[:n]
        _powers[k] = grown
    return _powers[k][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits (a bijection)."""
    h = h ^ (h >> U64(31))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(29)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, equal for equal bytes wherever they stand."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(len(data) + 1, True)[starts])


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.LargeBinaryArray:
    """Successive runs of bytes as an Arrow array, without copying them."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def span_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The bytes of ascending, disjoint spans as an Arrow array."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    return binaries(data[inside], np.concatenate([[0], np.cumsum(ends - starts)]))


def stretches(data: np.ndarray, inside: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of about ``size`` bytes that end outside runs of ``inside``, if there is such a place.

    Data of up to two sizes is one stretch; so is a run of ``inside`` however long.
    """
    at = 0
    while at < len(data):
        end = min(len(data), at + size) if len(data) > 2 * size else len(data)
        while end < len(data) and not len(gap := np.flatnonzero(~inside[data[end : end + 65536]])):
            end += 65536
        end = min(len(data), end + int(gap[0]) if end < len(data) else end)
        yield at, end
        at = end


def run_codes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, filled: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A number for each maximal run of ``inside``, equal exactly for equal bytes, and the runs before each text.

    With ``filled``, runs without such a byte do not count.  Bytes are compared, not hashes.
    """
    found, bounds, n = [], np.zeros(len(offsets), np.int64), 0
    for a, b in stretches(data, inside) if len(offsets) == 2 else [(0, len(data))]:
        own = data[a:b]
        starts, ends, own_bounds = words(own, np.clip(offsets - a, 0, b - a), inside)
        if filled is not None and len(starts):
            before = np.concatenate([[0], np.cumsum(filled[own], dtype=np.int32)])
            some = before[ends] > before[starts]
            own_bounds = np.concatenate([[0], np.cumsum(some)])[own_bounds]
            starts, ends = starts[some], ends[some]
        bounds[1:] = n + own_bounds[1:]
        n += len(starts)
        found.append(span_array(own, starts, ends).dictionary_encode())
    if not n:
        return np.zeros(0, np.int32), bounds
    return np.concatenate([c.indices.to_numpy() for c in pa.chunked_array(found).unify_dictionaries().chunks]), bounds


def of_text(bounds: np.ndarray) -> np.ndarray:
    """The number of the text of each run, from the third result of :func:`words`."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sums_by(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive bounds."""
    total = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64) if values.dtype.kind in "bui" else values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
