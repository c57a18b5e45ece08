"""Repeated byte strings across documents, by suffix arrays over anchored pieces of text.

A string of 50 bytes is represented by its anchor, the 26-byte string in it whose hash is smallest;
equal strings have equal anchors at equal places.  The strings of a text that share one anchor
occurrence form a piece of at most 74 bytes.  The work goes in three steps.

1. Anchors.  Every text is cut into pieces; (anchor hash, piece hash) pairs go to the anchor's
   partition in packed columns.  A piece that also stands in a smaller document is removed whole.
   Among the rest, only anchors with different pieces in different documents need a closer look.
2. Suffixes.  The bytes of those pieces are gathered.  A piece is written as eight-byte blocks
   outward from its anchor; the blocks of all pieces of a partition are sorted as one sequence by
   linear grouping (``lyndon_suffixes``).  Two strings are equal if their suffixes fall into one
   class over the whole blocks they cover and the few bytes beyond the blocks are equal, so this
   step compares bytes, not hashes.
3. Removal.  Spans of both steps meet their texts; covered bytes are counted and left out.

Each task folds equal pieces of its documents before it sends them.  An anchor with many different
pieces (the edge of a passage in a large share of all documents, with other text beyond it) would
gather them in one partition: its pieces are taken apart into their strings, each of which is met in
the partition of its own hash by step 1 alone, as a piece that is equal as a whole.  Equal strings are
folded before they are sent, so a string in any number of documents comes once from each slice.

A text beyond a slice is worked on in stretches that overlap by less than a string: a string's anchor
rests on its own bytes only, so a cut through a piece makes two pieces and loses no string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions, ship
from .lyndon_suffixes import prefix_classes, suffix_array
from .textarrays import U64, mix, of_text, powers, slices

SIZE = 50
ANCHOR = 26
REACH = SIZE - ANCHOR  # bytes beside the anchor in a string, on both sides together
PIECE = SIZE + REACH  # the longest piece
BLOCK = 8
#: Different pieces of one anchor in one slice of a task's documents, and in all, that make it hot.
HOT_IN_SLICE, HOT = 24, 4096
#: Bytes of documents within which a task folds equal pieces.
FOLD_BYTES = 1 << 20
#: Strings of hot pieces that a task folds at a time.
HELD_STRINGS = 250_000

PACKED = "part int, kind int, n int, a binary, x binary, doc binary, row binary, lo binary, strings binary"
_KINDS = {"a": "<u8", "x": "<u8", "doc": "<i8", "row": "<i8", "lo": "<u4", "strings": "u1"}
#: Kinds of packed rows: anchors, spans to remove, pieces to fetch, pieces to fetch of hot anchors.
ANCHORS, GONE, FETCH, FETCH_HOT = range(4)
_TOP = U64(0xFFFFFFFFFFFF0000)  # hashes travel as their upper 48 bits
#: Stands for "this anchor is hot" in place of a piece hash.
_IS_HOT = U64(0xFFFFFFFFFFFF0000)


def _thin(values: np.ndarray) -> bytes:
    """48-bit hashes: their three 16-bit digits."""
    return values.astype("<u8").view("<u2").reshape(-1, 4)[:, 1:].tobytes()


def _thick(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 4), "<u2")
    out[:, 1:] = np.frombuffer(raw, "<u2").reshape(-1, 3)
    return out.view("<u8").ravel()


def _pack(part: int, kind: int, columns: dict[str, np.ndarray], at: np.ndarray) -> dict:
    row = {"part": part, "kind": kind, "n": len(at)}
    for name, dtype in _KINDS.items():
        own = columns[name][at] if name in columns else np.zeros(0, dtype)
        row[name] = _thin(own) if dtype == "<u8" else own.astype(dtype).tobytes()
    return row


def _unpack(rows: list[dict]) -> dict[str, np.ndarray]:
    return {name: np.concatenate([_thick(r[name]) if dtype == "<u8" else np.frombuffer(r[name], dtype) for r in rows] or [np.zeros(0, dtype)]) for name, dtype in _KINDS.items()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 3 + [pa.binary()] * 6
    names = ["part", "kind", "n", *_KINDS]
    return pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds, strict=True)})


def _by_part(kind: int, columns: dict[str, np.ndarray], parts: np.ndarray) -> list[dict]:
    """One packed row for each part."""
    order = np.argsort(parts, kind="stable")
    cuts = np.flatnonzero(np.r_[True, parts[order][1:] != parts[order][:-1]]) if len(order) else []
    return [_pack(int(parts[own[0]]), kind, columns, own) for own in np.split(order, cuts[1:]) if len(own)]


def _sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while 2 * width <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (size - width)], values[size - width :]) if size > width else values


def pieces(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Every anchor occurrence with its piece: anchor hash, piece hash, text, first string, strings.

    A string of two texts or beyond the end is none.  Of equal hashes the leftmost anchors.
    """
    none = {"a": np.zeros(0, U64), "x": np.zeros(0, U64), "text": np.zeros(0, np.int64), "lo": np.zeros(0, np.int64), "strings": np.zeros(0, np.int64)}
    n = len(data)
    if n < SIZE:
        return none
    sums = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(n), out=sums[1:])
    inverse = powers(n + 1, True)
    hashes = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: n - ANCHOR + 1])
    best = _sliding_min((hashes & U64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=U64), REACH + 1)
    text = of_text(offsets)
    start = np.flatnonzero(text[: n - SIZE + 1] == text[SIZE - 1 :])
    if not len(start):
        return none
    anchor, own = (best[start] & U64(0xFFFFFFFF)).astype(np.int64), text[start]
    heads = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])])
    lo, strings, at = start[heads], np.diff(np.r_[heads, len(start)]), anchor[heads]
    ends = lo + strings + SIZE - 1
    x = mix((sums[ends] - sums[lo]) * inverse[lo] + (at - lo).astype(U64) * U64(0x632BE59BD9B4E019) + strings.astype(U64))
    x = np.where((x & _TOP) == _IS_HOT, U64(0), x)
    return {"a": hashes[at] & _TOP, "x": x & _TOP, "text": own[heads], "lo": lo - offsets[own[heads]], "strings": strings}


def _fold(found: dict[str, np.ndarray], parts: int, turn: int, hot_in_slice: int) -> list[dict]:
    """What one slice sends: pieces not already known from a smaller document of the slice.

    Of an anchor with many different pieces only the mark that it is hot goes to the anchor's
    partition; its pieces are fetched directly.
    """
    rows: list[dict] = []
    order = np.lexsort((found["doc"], found["x"], found["a"]))
    a, x, doc = (found[k][order] for k in ("a", "x", "doc"))
    head = np.r_[True, (a[1:] != a[:-1]) | (x[1:] != x[:-1])] if len(a) else np.zeros(0, bool)
    least = doc[np.flatnonzero(head)][np.cumsum(head) - 1] if len(a) else doc
    gone = np.zeros(len(order), bool)
    gone[order] = doc > least
    a_head = np.r_[True, a[1:] != a[:-1]] if len(a) else head
    different = np.bincount(np.cumsum(a_head) - 1, head) if len(a) else np.zeros(0)
    hot = np.zeros(len(order), bool)
    hot[order] = (different > hot_in_slice)[np.cumsum(a_head) - 1] if len(a) else hot
    if gone.any():
        rows.append(_pack(turn % parts, GONE, found, np.flatnonzero(gone)))
    if (hot & ~gone).any():
        rows.append(_pack(turn % parts, FETCH_HOT, found, np.flatnonzero(hot & ~gone)))
        marks = np.unique(found["a"][hot])
        mark = {"a": marks, "x": np.full(len(marks), _IS_HOT), "doc": np.zeros(len(marks), np.int64), "row": np.zeros(len(marks), np.int64), "lo": np.zeros(len(marks), np.int64), "strings": np.zeros(len(marks), np.int64)}
        rows += _by_part(ANCHORS, mark, _part_of(marks, parts))
    rest = np.flatnonzero(~gone & ~hot)
    own = {k: v[rest] for k, v in found.items() if k != "text"}
    return rows + _by_part(ANCHORS, own, _part_of(own["a"], parts))


def _part_of(a: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(a) >> U64(16)) % U64(parts)).astype(np.int64)


def _send(parts: int, hot_in_slice: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            doc, row = (batch.column(c).to_numpy() for c in ("doc", "row"))
            for lo, _, data, offsets in slices(batch.column("text"), FOLD_BYTES):
                for found in _stretches(data, offsets):
                    found["doc"], found["row"] = doc[lo + found["text"]], row[lo + found["text"]]
                    turn += 1
                    if rows := _fold(found, parts, turn + int(doc[lo]), hot_in_slice):
                        yield _batch(rows)
        pa.default_memory_pool().release_unused()

    return run


def _stretches(data: np.ndarray, offsets: np.ndarray, size: int = FOLD_BYTES) -> Iterator[dict[str, np.ndarray]]:
    """The pieces of a slice; of a text much longer than a slice, those of its stretches in turn."""
    if len(data) <= 2 * size:
        yield pieces(data, offsets)
        return
    for at in range(0, len(data), size):  # one text
        own = data[at : at + size + SIZE - 1]
        found = pieces(own, np.array([0, len(own)]))
        found["lo"] = found["lo"] + at
        yield found


def _meet(parts: int, most_pieces: int):
    """Step 1 in one partition: whole pieces of smaller documents, and pieces to fetch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            own = batch.to_pylist()
            rows += [r for r in own if r["kind"] == ANCHORS]
            if straight := [r for r in own if r["kind"] != ANCHORS]:
                yield _batch([p | {"part": q} for r in straight for p, q in _by_row(r)])
        all_ = _unpack(rows)
        del rows
        marks = np.unique(all_["a"][all_["x"] == _IS_HOT])
        real = all_["x"] != _IS_HOT
        all_ = {k: v[real] for k, v in all_.items()}
        order = np.lexsort((all_["doc"], all_["x"], all_["a"]))
        a, x, doc = (all_[k][order] for k in ("a", "x", "doc"))
        if not len(a):
            return
        a_head = np.r_[True, a[1:] != a[:-1]]
        head = a_head | np.r_[True, x[1:] != x[:-1]]
        of_a, of_x = np.cumsum(a_head) - 1, np.cumsum(head) - 1
        gone = doc > doc[head][of_x]
        different = np.bincount(of_a, head)
        kept = np.where(gone, np.iinfo(np.int64).max, doc)
        least = np.minimum.reduceat(kept, np.flatnonzero(a_head))
        most = np.maximum.reduceat(np.where(gone, np.iinfo(np.int64).min, doc), np.flatnonzero(a_head))
        hot = (different > most_pieces) | np.isin(a[a_head], marks)
        look = ~gone & ((different > 1) & (least < most))[of_a] & ~hot[of_a]
        del a, x, doc, kept, a_head, head, of_x
        for kind, chosen in ((GONE, gone), (FETCH, look), (FETCH_HOT, ~gone & hot[of_a])):
            if chosen.any():
                at = order[chosen]
                own = {k: v[at] for k, v in all_.items()}
                yield _batch(_by_part(kind, own, _row_part(own["row"], parts)))
        pa.default_memory_pool().release_unused()

    def _by_row(packed: dict) -> list[tuple[dict, int]]:
        own = _unpack([packed])
        return [(r, r["part"]) for r in _by_part(packed["kind"], own, _row_part(own["row"], parts))]

    return run


def _row_part(row: np.ndarray, parts: int) -> np.ndarray:
    return (row.view(U64) % U64(parts)).astype(np.int64)


def _rows(kinds: tuple[int, ...]):
    """Packed rows of one partition as one row for each document: its spans or pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = [r for batch in batches for r in batch.to_pylist()]
        all_ = _unpack(packed)
        kind = np.concatenate([np.full(r["n"], r["kind"], "u1") for r in packed] or [np.zeros(0, "u1")])
        order = np.lexsort((all_["lo"], all_["doc"], all_["row"]))
        row, doc = all_["row"][order], all_["doc"][order]
        cuts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])]) if len(row) else np.zeros(0, int)
        ends = np.r_[cuts[1:], len(row)]
        for k in range(0, len(cuts), 4096):
            out = {"m_doc": doc[cuts[k : k + 4096]], "m_row": row[cuts[k : k + 4096]]}
            spans = [order[b:e] for b, e in zip(cuts[k : k + 4096], ends[k : k + 4096], strict=True)]
            out["lo"] = pa.array([all_["lo"][s].tobytes() for s in spans], pa.binary())
            out["strings"] = pa.array([all_["strings"][s].tobytes() for s in spans], pa.binary())
            out["a"] = pa.array([_thin(all_["a"][s]) if FETCH in kinds else b"" for s in spans], pa.binary())
            out["kinds"] = pa.array([kind[s].tobytes() for s in spans], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return run


BY_ROW = "m_doc long, m_row long, lo binary, strings binary, a binary, kinds binary"


def _gather(parts: int):
    """Texts with the pieces to fetch -> packed pieces by anchor partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {k: [] for k in ("a", "doc", "row", "lo", "strings", "bytes")}
            texts = batch.column("text").cast(pa.large_binary())
            for k, (doc, row, lo, strings, a, kinds) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("m_doc", "m_row", "lo", "strings", "a", "kinds")), strict=True)):
                mine = np.frombuffer(kinds, "u1") == FETCH
                if not mine.any():
                    continue
                lo, strings = np.frombuffer(lo, "<u4")[mine].astype(np.int64), np.frombuffer(strings, "u1")[mine]
                data = np.concatenate([np.frombuffer(texts[k].as_buffer(), np.uint8), np.zeros(PIECE, np.uint8)])
                columns["bytes"].append(data[lo[:, None] + np.arange(PIECE)])
                for name, value in (("a", _thick(a)[mine]), ("doc", np.full(len(lo), doc)), ("row", np.full(len(lo), row)), ("lo", lo), ("strings", strings)):
                    columns[name].append(value)
            if not columns["a"]:
                continue
            whole = {k: np.concatenate(v) for k, v in columns.items()}
            part = _part_of(whole["a"], parts)
            order = np.argsort(part, kind="stable")
            rows = []
            for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                rows.append(_pack(int(part[own[0]]), FETCH, whole, own) | {"bytes": whole["bytes"][own].tobytes()})
            names = ["part", "n", *_KINDS, "bytes"]
            yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], pa.int32() if c in ("part", "n") else pa.binary()) for c in names})

    return run


PIECES = "part int, n int, a binary, x binary, doc binary, row binary, lo binary, strings binary, bytes binary"


def _packed(block: np.ndarray) -> np.ndarray:
    """Up to eight bytes of each row as one number."""
    out = np.zeros(len(block), U64)
    for k in range(block.shape[1]):
        out |= block[:, k].astype(U64) << U64(8 * k)
    return out


def shared_strings(a: np.ndarray, doc: np.ndarray, strings: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, string in the piece) of the strings that also stand in a piece of a smaller document.

    ``data`` has one row of PIECE bytes for each piece; its first ``strings`` strings count.  The
    sequence that is sorted has, for each piece, whole blocks left of the anchor, the anchor, whole
    blocks right of it, and a separator.
    """
    n, every = len(a), np.arange(len(a))
    hashes = np.stack([_anchor_hash(data[:, k : k + ANCHOR]) for k in range(REACH + 1)], axis=1)
    off = np.argmin((hashes & U64(0xFFFFFFFF00000000)) | np.arange(REACH + 1, dtype=U64), axis=1)
    left, right = off // BLOCK, (strings.astype(np.int64) + SIZE - 1 - off - ANCHOR) // BLOCK
    most = REACH // BLOCK
    places = np.zeros((n, 2 * most + 2), U64)
    used = np.zeros((n, 2 * most + 2), bool)
    column = np.arange(PIECE)
    for k in range(most):
        has = left >= most - k
        at = off[has] - BLOCK * (most - k)
        places[has, k], used[has, k] = mix(_packed(data[every[has][:, None], at[:, None] + column[:BLOCK]])), True
        has = right > k
        at = off[has] + ANCHOR + BLOCK * k
        places[has, most + 1 + k], used[has, most + 1 + k] = mix(_packed(data[every[has][:, None], at[:, None] + column[:BLOCK]])), True
    places[:, most], used[:, most] = mix(a + U64(1)), True
    places[:, -1], used[:, -1] = 0, True
    flat = np.flatnonzero(used.ravel())
    symbols = np.unique(places.ravel()[flat], return_inverse=True)[1]
    where = np.full(used.size, -1)
    where[flat] = np.arange(len(flat))
    where = where.reshape(used.shape)
    classes = prefix_classes(symbols, suffix_array(symbols), 2 * most + 1)

    out_piece, out_string = [], []
    for before in range(REACH + 1):  # bytes of the string before the anchor
        string = off - before
        own = np.flatnonzero((string >= 0) & (string < strings))
        if not len(own):
            continue
        after = REACH - before
        blocks_left, blocks_right = before // BLOCK, after // BLOCK
        core = classes[blocks_left + blocks_right][where[own, most - blocks_left]]
        at = string[own][:, None]
        head = _packed(data[own[:, None], at + column[: before % BLOCK]])
        tail = _packed(data[own[:, None], at + SIZE - after % BLOCK + column[: after % BLOCK]])
        order = np.lexsort((doc[own], tail, head, core))
        c, h, t, d = core[order], head[order], tail[order], doc[own][order]
        first = np.r_[True, (c[1:] != c[:-1]) | (h[1:] != h[:-1]) | (t[1:] != t[:-1])]
        gone = d > d[first][np.cumsum(first) - 1]
        out_piece.append(own[order[gone]])
        out_string.append(string[own[order[gone]]])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(out_piece), join(out_string)


def _anchor_hash(block: np.ndarray) -> np.ndarray:
    """The hash of :func:`pieces` for rows of bytes."""
    return mix(((block.astype(U64) + U64(1)) * powers(block.shape[1])).sum(axis=1, dtype=U64))


def _resolve(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        all_ = _unpack(rows)
        if not len(all_["a"]):
            return
        data = np.concatenate([np.frombuffer(r["bytes"], np.uint8) for r in rows]).reshape(-1, PIECE)
        del rows
        piece, string = shared_strings(all_["a"], all_["doc"], all_["strings"], data)
        if not len(piece):
            return
        order = np.lexsort((string, piece))
        piece, string = piece[order], string[order]
        heads = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | (string[1:] != string[:-1] + 1)])
        own = piece[heads]
        gone = {"doc": all_["doc"][own], "row": all_["row"][own], "lo": all_["lo"][own] + string[heads], "strings": np.diff(np.r_[heads, len(piece)])}
        yield _batch(_by_part(GONE, gone, _row_part(gone["row"], parts)))
        pa.default_memory_pool().release_unused()

    return run


def _hot_strings(parts: int):
    """Every string of the hot pieces of a text by a hash of its own, as a piece of one string."""

    def folded(out: dict[str, list], turn: int) -> Iterator[pa.RecordBatch]:
        hashes = np.frombuffer(b"".join(out["h"]), "<u8").reshape(-1, 2)
        found = {"a": hashes[:, 0] & _TOP, "x": hashes[:, 1] & _TOP, "strings": np.ones(len(hashes), np.int64)} | {k: np.array(out[k], np.int64) for k in ("doc", "row", "lo")}
        found["x"] = np.where(found["x"] == _IS_HOT, U64(0), found["x"])
        if rows := _fold(found, parts, turn, PIECE * len(hashes)):
            yield _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {k: [] for k in ("h", "doc", "row", "lo")}
        turn = 0
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for k, (doc, row, lo, strings, kinds) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("m_doc", "m_row", "lo", "strings", "kinds")), strict=True)):
                mine = np.frombuffer(kinds, "u1") == FETCH_HOT
                raw = memoryview(texts[k].as_buffer()) if mine.any() else b""
                for first, n in zip(np.frombuffer(lo, "<u4")[mine].tolist(), np.frombuffer(strings, "u1")[mine].tolist(), strict=True):
                    out["h"] += [hashlib.blake2b(raw[s : s + SIZE], digest_size=16).digest() for s in range(first, first + n)]
                    out["lo"] += range(first, first + n)
                    out["doc"] += [doc] * n
                    out["row"] += [row] * n
                if len(out["h"]) > HELD_STRINGS:
                    turn += 1
                    yield from folded(out, turn + doc)
                    out = {k: [] for k in out}
        if out["h"]:
            yield from folded(out, turn + out["doc"][0])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        texts = batch.column("text").cast(pa.large_binary())
        for k, (lo, strings) in enumerate(zip(batch.column("lo").to_pylist(), batch.column("strings").to_pylist(), strict=True)):
            raw = texts[k].as_py() or b""
            spans: list[tuple[int, int]] = []
            if lo:
                starts = np.frombuffer(lo, "<u4").astype(np.int64)
                order = np.argsort(starts, kind="stable")
                ends = np.maximum.accumulate((starts + np.frombuffer(strings, "u1") + SIZE - 1)[order])
                starts = starts[order]
                heads = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
                spans = list(zip(starts[heads].tolist(), ends[np.r_[heads[1:] - 1, len(ends) - 1]].tolist(), strict=True))
            kept, at = hashlib.sha256(), 0
            for s, e in spans:
                kept.update(raw[at:s])
                at = e
            kept.update(raw[at:])
            for name, value in zip(out, (len(raw), sum(e - s for s, e in spans), len(spans), kept.hexdigest(), [{"start": s, "end": e} for s, e in spans]), strict=True):
                out[name].append(value)
        kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        yield pa.RecordBatch.from_pydict({"id": batch.column("doc")} | {k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_in_slice: int = HOT_IN_SLICE, hot: int = HOT) -> DataFrame:
    """For every row: id, bytes, removed bytes and spans, the digest of the kept bytes, and the spans.

    A byte goes if a 50-byte string covers it that also starts in a row with a smaller id; strings
    are judged on the input.  Null and empty texts have no bytes; rows of one id do not remove each
    other's bytes; rows without an id neither lose bytes nor make others lose them; an empty table
    gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "repeats")
    parts = partitions(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text")).withColumn("row", F.xxhash64("doc", "text"))

    sent = rows.where("doc is not null and length(text) > 0").mapInArrow(_send(parts, hot_in_slice), PACKED)
    found = scratch.save(sent.repartitionById(parts, F.col("part")).mapInArrow(_meet(parts, hot), PACKED), "found")

    wanted = found.where(F.col("kind").isin(FETCH, FETCH_HOT)).repartitionById(parts, F.col("part")).mapInArrow(_rows((FETCH, FETCH_HOT)), BY_ROW)
    wanted = scratch.save(wanted, "wanted")
    texts = rows.dropDuplicates(["doc", "row"]) if _twice(rows) else rows
    fetched = texts.join(wanted, (texts["doc"] == wanted["m_doc"]) & (texts["row"] == wanted["m_row"])).select("text", *wanted.columns)
    close = fetched.select("text", "m_doc", "m_row", "lo", "strings", "a", "kinds").mapInArrow(_gather(parts), PIECES)
    close = scratch.save(close.repartitionById(parts, F.col("part")).mapInArrow(_resolve(parts), PACKED), "close")
    gone = found.where(F.col("kind") == GONE).unionByName(close)

    of_hot = wanted.where(F.hex("kinds").rlike(f"^(..)*0{FETCH_HOT}"))
    if not of_hot.limit(1).isEmpty():
        strings = texts.join(of_hot, (texts["doc"] == of_hot["m_doc"]) & (texts["row"] == of_hot["m_row"])).select("text", *of_hot.columns)
        met = strings.mapInArrow(_hot_strings(parts), PACKED).repartitionById(parts, F.col("part")).mapInArrow(_meet(parts, hot), PACKED)
        gone = gone.unionByName(met.where(F.col("kind") == GONE))

    spans = scratch.save(gone.repartitionById(parts, F.col("part")).mapInArrow(_rows((GONE,)), BY_ROW), "spans")
    scratch.drop("found", "wanted", "close")
    joined = rows.join(spans, (rows["doc"] == spans["m_doc"]) & (rows["row"] == spans["m_row"]), "left").select("doc", "text", "lo", "strings")
    return joined.mapInArrow(_remove, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def _twice(rows: DataFrame) -> bool:
    """Whether some id stands in several rows; reads the ids only."""
    return not rows.where("doc is not null").groupBy("doc").count().where("count > 1").limit(1).isEmpty()
