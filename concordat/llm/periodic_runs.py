"""Periodic runs: stretches of words that repeat with some period, found by matching blocks.

A text's words become numbers.  For each scale, a power of two, its aligned blocks of that many words
are the keys of an Aho-Corasick automaton over numbers, which reads the text; where a block stands
again at a distance of that scale (from the block's size to below twice that; the least scale takes all
smaller distances), neighbouring blocks of one distance are joined and extended word by word to both
sides.  A run of period q and three periods holds a whole aligned block, and its copy q words on, of
the scale of q, so none is missed.

Three exact rules keep the work at about n log n.  A key is as long as the blocks of the least scale: larger
blocks are keys of numbers that stand for pairs, fours and so on of words, so no match has long chains
of shorter ones within it.  A block enters the automaton only if each of
its words stands again within the distances of the scale.  And a block inside a run R of a period of
at most a third of the block, whose copy is inside a run S of that period, can belong to a run
of another period only if R and S end or begin at that distance: otherwise what matches lies within R.
"""

from __future__ import annotations

from fractions import Fraction

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .textarrays import NOT_SPACE, run_codes, slices, stretches, words

#: A run has at least this many words, and this many periods.
LEAST, TIMES = 24, 3
#: Words that one automaton holds, unless a single block is longer; words compared at once.
_HELD, _STEP = 1 << 17, 16
SCHEMA = "runs array<struct<start: bigint, length: bigint, period: bigint>>, longest struct<start: bigint, length: bigint, period: bigint>, kept string"


def least_scale(least: int = LEAST, times: int = TIMES) -> int:
    """The greatest block size whose block and copy fit in every run of a period below twice that."""
    size = 1
    while all(4 * size - 1 + q <= max(least, times * q) for q in range(1, 4 * size)):
        size *= 2
    return size


def find(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all maximal runs of numbers, by start and then period.

    A run's period is its smallest; it has at least ``least`` numbers and ``times`` periods (three or more).
    """
    if times < 3:
        raise ValueError("a run has three periods at least")
    n, runs = len(codes), np.zeros((0, 3), np.int64)
    if n < max(least, times):
        return runs
    order = np.argsort(codes, kind="stable")
    gap = np.full(n, n)  # to the next place of the same number
    same = codes[order[1:]] == codes[order[:-1]]
    gap[order[:-1][same]] = np.diff(order)[same]
    size = first = least_scale(least, times)
    names, width = codes.astype(np.int64), 1  # of the stretches of ``width`` numbers
    while times * size <= n or size == first:
        low, high = 1 if size == first else size, min(2 * size - 1, n // times)
        starts = np.flatnonzero(gap[: n // size * size].reshape(-1, size).max(axis=1) <= high) * size
        if len(starts):
            while width * first < size:
                pair = names[:-width] * (int(names.max()) + 1) + names[width:]
                names, width = np.unique(pair, return_inverse=True)[1], 2 * width
            runs = np.concatenate([runs, _at_scale(codes, names, width, starts, size, low, high, runs, least, times)])
        size *= 2
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _at_scale(
    codes: np.ndarray, names: np.ndarray, width: int, starts: np.ndarray, size: int, low: int, high: int, runs: np.ndarray, least: int, times: int
) -> np.ndarray:
    """The runs of periods ``low`` to ``high``, seeded by the blocks at ``starts``."""
    pairs, own = [], runs[(3 * runs[:, 2] <= size) & (runs[:, 1] >= size)]
    own = own[np.argsort(own[:, 0])]  # none within another, so their ends ascend too
    lo = 0
    while lo < len(starts):
        hi = lo + 1
        while hi < len(starts) and starts[hi] - starts[hi - 1] <= high + size and starts[hi] + size - starts[lo] <= _HELD:
            hi += 1
        at, distance = _copies(names, width, starts[lo:hi], size, low, high)
        some = _may_seed(at, distance, size, own)
        pairs.append((at[some], distance[some]))
        lo = hi
    at, d = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.lexsort((at, d))
    at, d = at[order], d[order]
    if not len(at):
        return runs[:0]
    new = np.append(True, (np.diff(d) != 0) | (np.diff(at) != size))
    head = np.flatnonzero(new)
    x, y, d = at[head], at[np.append(head[1:], len(at)) - 1] + size, d[head]
    some = y - x + 2 * size - 2 >= np.maximum(least - d, (times - 1) * d)  # less than a block is added on a side
    x, y, d = x[some], y[some], d[some]
    x, y = _extended(codes, x, d, -1), _extended(codes, y, d, 1)
    found = np.unique(np.stack([x, y - x + d, d], axis=1)[y - x + d >= np.maximum(least, times * d)], axis=0)
    return np.array([r for r in found if _primitive(codes[r[0] : r[0] + r[2]])], np.int64).reshape(-1, 3)


def _copies(names: np.ndarray, width: int, starts: np.ndarray, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of a block, distance of a copy) for all copies within the distances.

    A block's key is the names of its stretches of ``width``, side by side; the text is read once for each
    offset of such stretches, with a number that no key has between offsets.
    """
    base, keys = int(starts[0]), size // width
    own = names[base : starts[-1] + size + high]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for s in (starts - base).tolist():
        automaton.add_word(tuple(own[s : s + size : width].tolist()), s)  # of equal blocks the last gives the number
    automaton.make_automaton()
    rows = -(-len(own) // width) + 1  # of one offset, and what stands between
    table = np.full((rows, width), int(names.max()) + 1)
    table.reshape(-1)[: len(own)] = own
    place, block = [], []
    for a in range(0, width, step := max(1, _HELD // rows)):
        text = table[:, a : a + step].T
        hits = np.fromiter((v for hit in automaton.iter(tuple(text.reshape(-1).tolist())) for v in hit), np.int64).reshape(-1, 2)
        first = hits[:, 0] - (keys - 1)
        place.append(first // rows + a + first % rows * width)
        block.append(hits[:, 1])
    place, block = np.concatenate(place), np.concatenate(block)
    order = np.lexsort((place, block))
    place, key = place[order], block[order] * (len(own) + 1) + place[order]
    number = np.zeros(len(own), np.int64)
    number[place] = block[order]
    want = number[starts - base] * (len(own) + 1) + starts - base
    end = (number[starts - base] + 1) * (len(own) + 1) - 1
    a, b = np.searchsorted(key, want + low), np.searchsorted(key, np.minimum(want + high, end), "right")
    count = np.maximum(b - a, 0)
    at = np.repeat(starts, count)
    which = np.arange(len(at)) + np.repeat(a - np.cumsum(count) + count, count)
    return at, place[which] + base - at


def _may_seed(at: np.ndarray, d: np.ndarray, size: int, own: np.ndarray) -> np.ndarray:
    """False where a block and its copy lie in runs of one small period that neither begin nor end at ``d``."""
    if not len(own):
        return np.ones(len(at), bool)
    begin, end = own[:, 0], own[:, 0] + own[:, 1]

    def within(p: np.ndarray) -> np.ndarray:
        k = np.searchsorted(begin, p, "right") - 1
        return np.where((k >= 0) & (end[k] >= p + size), k, -1)

    a, b = within(at), within(at + d)
    aligned = (end[b] - end[a] == d) | (begin[b] - begin[a] == d)
    return (a < 0) | (b < 0) | ((a != b) & aligned)


def _extended(codes: np.ndarray, edge: np.ndarray, d: np.ndarray, way: int) -> np.ndarray:
    """``edge`` moved on as long as the numbers beyond it equal those ``d`` further."""
    edge, active = edge.copy(), np.arange(len(edge))
    step = np.arange(_STEP) if way > 0 else -1 - np.arange(_STEP)
    while len(active):
        at = edge[active, None] + step
        to = at + d[active, None]
        inside = (at >= 0) & (to < len(codes))
        equal = inside & (codes[np.where(inside, at, 0)] == codes[np.where(inside, to, 0)])
        more = np.where(equal.all(axis=1), _STEP, equal.argmin(axis=1))
        edge[active] += way * more
        active = active[more == _STEP]
    return edge


def _primitive(unit: np.ndarray) -> bool:
    """Whether ``unit`` is not a shorter one several times over."""
    left, factor = len(unit), 2
    while left > 1:
        factor = factor if factor * factor <= left else left
        if left % factor:
            factor += 1
            continue
        part = len(unit) // factor
        if np.array_equal(unit[part:], unit[:-part]):
            return False
        while left % factor == 0:
            left //= factor
    return True


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words at these places with a space between them."""
    out = []
    for k in range(0, len(starts), 1 << 16):
        s, e = starts[k : k + (1 << 16)], ends[k : k + (1 << 16)]
        held = data[s[0] : e[-1]].tobytes()
        out.append(b" ".join([held[i:j] for i, j in zip((s - s[0]).tolist(), (e - s[0]).tolist(), strict=True)]))
    return b" ".join(out)


def _of_texts(batch: pa.RecordBatch, least: int, times: int) -> dict:
    runs, longest, kept = [], [], []
    for _, _, data, offsets in slices(batch.column("text")):
        codes, bounds = run_codes(data, offsets, NOT_SPACE)
        starts, ends = _bounds(data, offsets)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            found = find(codes[a:b], least, times)
            edges = np.zeros(b - a + 1, np.int32)
            np.add.at(edges, found[:, 0] + found[:, 2], 1)
            np.add.at(edges, found[:, 0] + found[:, 1], -1)
            stay = np.cumsum(edges[:-1]) == 0
            rows = [dict(zip(("start", "length", "period"), r, strict=True)) for r in found.tolist()]
            runs.append(rows)
            longest.append(max(rows, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]), default=None))
            kept.append(_joined(data, starts[a:b][stay], ends[a:b][stay]))
    kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    return {"id": batch.column("id"), "runs": pa.array(runs, pa.list_(kind)), "longest": pa.array(longest, kind), "kept": pa.array(kept, pa.binary()).cast(pa.string())}


def _bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; those of a very long text by stretches."""
    if len(offsets) > 2:
        return words(data, offsets, NOT_SPACE)[:2]
    parts = [tuple(x + a for x in words(data[a:b], np.array([0, b - a]), NOT_SPACE)[:2]) for a, b in stretches(data, NOT_SPACE)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """For every row: id, its runs by start and period, the longest of them, and the text without repetitions.

    Words are maximal runs of other than ASCII white space, numbered from 0.  The longest run has the most
    periods (ties: smallest start, then period); it is null where there is none.  Words that any run
    contains after its first period go, the others are joined by single spaces.

    Map-only.  A null or empty text has no words, no runs and keeps ''; repeated rows give equal rows;
    other columns are not read; an empty table gives no rows.  Texts are taken whole however long.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, _of_texts, f"id {kind}, {SCHEMA}", least, times)
