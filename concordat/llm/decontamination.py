"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, texts scanned once.

Items and texts are normalised alike: lower-cased A-Z, words of letters, digits and non-ASCII
characters.  The automaton reads words, not characters: every run of 13 words of an item is a
pattern over numbered words, an item with fewer words is one pattern, and a word that no item has
ends every match.  Word places are mapped back to places in the original text.

Test items of more than ITEM_BYTES bytes are dealt by their hash to groups of about that size; each
group has an automaton and reads the texts once, writing only what it hits, so items in any
number are scanned, no text is written again, and no task or driver holds more than two groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, in_arrow, kept
from .textarrays import ALNUM, LOWER, slices, span_array, stretches, words

WINDOW = 13
#: A text with hits is contaminated if this many times its hit words reach its words.
SHARE = 20
#: Bytes of test items of one group; a megabyte of text makes an automaton of about 0.1 GB.
ITEM_BYTES = 2 << 20
_OWNER = "decontamination"

_SPACED = bytes(c if ALNUM[c] else 32 for c in LOWER.tolist())  # lower-case, other bytes to spaces


class Automaton:
    """The automaton over (item, text) rows; ``ids`` has the items that have a name."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        texts = [(item, text.translate(_SPACED).split()) for item, text in items]
        vocabulary = sorted({w for _, own in texts for w in own})
        number = {w: k for k, w in enumerate(vocabulary, 1)}  # 0: a word of no item
        self.vocabulary = pa.array(vocabulary, pa.large_binary())
        self.ids = sorted({i for i, _ in items if i is not None})
        place = {i: k for k, i in enumerate(self.ids)}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, own in texts:
            numbers = tuple(number[w] for w in own)
            for k in range(max(1, len(own) - window + 1) if own else 0):
                owner = owners.setdefault(numbers[k : k + window], set())
                if item is not None:
                    owner.add(place[item])
        self.shortest = min(map(len, owners), default=0)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, own in owners.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(sorted(own))))
        if owners:
            self.automaton.make_automaton()

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found = pc.index_in(span_array(data, starts, ends), value_set=self.vocabulary)
        return pc.fill_null(found, -1).to_numpy().astype(np.int64) + 1

    def scan(self, numbers: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """[(first word, word after the last)] of the occurrences, and the items they belong to."""
        if not self.shortest:
            return [], set()
        unknown = np.flatnonzero(numbers == 0)
        if np.diff(unknown, prepend=-1, append=len(numbers)).max(initial=0) <= self.shortest:
            return [], set()  # no run of known words is as long as a pattern
        found = list(self.automaton.iter(tuple(numbers.tolist())))
        return [(end + 1 - size, end + 1) for end, (size, _) in found], {k for _, (_, own) in found for k in own}


def _automaton(held: Broadcast) -> Automaton:
    """Built once in each Python worker, and dropped when another is."""
    key, items, window = held.value
    built = kept(_OWNER)
    if key not in built:
        built.clear()
        built[key] = Automaton(items, window)
    return built[key]


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _hits(column: pa.Array, automaton: Automaton) -> Iterator[tuple[int, list[tuple[int, int]], list[tuple[int, int]], list[str]]]:
    """For every text: words, merged hit runs in words and in code points, and items that occur."""
    for lo, hi, data, offsets in slices(column):
        alone = hi - lo == 1
        numbers, points, bounds = [], [], np.zeros(len(offsets), np.int64)
        at = 0
        for a, b in stretches(data, ALNUM) if alone else [(0, len(data))]:
            own = LOWER[data[a:b]]
            starts, ends, own_bounds = words(own, np.clip(offsets - a, 0, b - a), ALNUM)
            numbers.append(automaton.numbers(own, starts, ends))
            points.append((a + starts, a + ends))
            bounds[1:] = at + own_bounds[1:]
            at += len(starts)
        number = np.concatenate([np.zeros(0, np.int64), *numbers])
        for k in range(hi - lo):
            first, last = int(bounds[k]), int(bounds[k + 1])
            runs, items = automaton.scan(number[first:last]) if last > first else ([], set())
            runs, spans = _merged(runs), []
            if runs:
                starts, ends = (np.concatenate(x)[first:last] - offsets[k] for x in zip(*points, strict=True))
                before = np.concatenate([[0], np.cumsum((data[offsets[k] : offsets[k + 1]] & 0xC0) != 0x80)])
                spans = [(int(before[starts[x]]), int(before[ends[y - 1]])) for x, y in runs]
            yield last - first, runs, spans, [automaton.ids[i] for i in sorted(items)]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPAN_TYPE = "array<struct<start:long,end:long>>"
_FOUND = f"row {{}}, n_words long, items array<string>, runs {_SPAN_TYPE}, spans {_SPAN_TYPE}"


def _pairs(found: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in found]


def _pass(held: Broadcast, field: str | None = None, hits_only: bool = False):
    """One group's hits beside the row, or a ``field`` of it; with ``hits_only`` of rows that have some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row = batch.column("row")
            n_words, runs, spans, items = (list(x) for x in zip(*_hits(row.field("text"), _automaton(held)), strict=True))
            made = pa.RecordBatch.from_pydict({
                "row": row if field is None else row.field(field), "n_words": pa.array(n_words, pa.int64()), "items": pa.array(items, pa.list_(pa.string())),
                "runs": pa.array(map(_pairs, runs), _SPANS), "spans": pa.array(map(_pairs, spans), _SPANS),
            })
            yield made.filter(pc.greater(pc.list_value_length(made.column("runs")), 0)) if hits_only else made

    return run


def _together(runs: list[dict], spans: list[dict]) -> tuple[list[dict], list[dict]]:
    """The runs of several groups merged, each with its span, as one automaton over all items would give them."""
    out: list[list[int]] = []
    for a, b, start, end in sorted((r["start"], r["end"], s["start"], s["end"]) for r, s in zip(runs, spans, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1], out[-1][3] = max(out[-1][1], b), max(out[-1][3], end)
        else:
            out.append([a, b, start, end])
    return _pairs([(a, b) for a, b, _, _ in out]), _pairs([(c, d) for _, _, c, d in out])


def _combined(batch: pa.RecordBatch) -> dict:
    both = [_together(r, s) for r, s in zip(batch.column("runs").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
    items = [sorted(set(x)) for x in batch.column("items").to_pylist()]
    return {
        "row": batch.column("row"), "n_words": batch.column("n_words"), "items": pa.array(items, pa.list_(pa.string())),
        "runs": pa.array([r for r, _ in both], _SPANS), "spans": pa.array([s for _, s in both], _SPANS),
    }


def hold_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> Iterator[Broadcast]:
    """The test items as broadcast groups of about ``item_bytes``, one after the other.

    Items without an id hit words but cannot be named; rows of one id are one item.
    """
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    groups = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes
    for group in range(groups):
        own = rows.where(F.pmod(F.xxhash64("text"), F.lit(groups)) == group) if groups > 1 else rows
        items = sorted(((r["id"], r["text"].encode()) for r in own.distinct().collect()), key=lambda r: (r[0] is None, r))
        key = hashlib.sha256(repr((items, window)).encode()).hexdigest()
        yield benchmark.sparkSession.sparkContext.broadcast((key, items, window))


def _by_text(rows: DataFrame, groups: Iterable[Broadcast]) -> DataFrame:
    """The hits of all groups by the SHA-256 of the text, for texts that have some.

    Each group reads the texts and writes its hits, no text; equal texts have equal hits and are one row.
    """
    texts = rows.where("row.text is not null").select(F.struct(F.sha2("row.text", 256).alias("key"), "row.text").alias("row"))
    scratch, parts = Scratch(rows.sparkSession, "contamination"), []
    for k, held in enumerate(groups):
        found = in_arrow(texts, _pass(held, "key", hits_only=True), _FOUND.format("string"), _OWNER).dropDuplicates(["row"])
        parts.append(scratch.save(found, f"group-{k}"))
        held.unpersist()
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("items", "runs", "spans")]
    hits = reduce(DataFrame.union, parts).groupBy("row").agg(F.first("n_words").alias("n_words"), *lists)
    return scratch.save(arrow_map(hits, _combined, _FOUND.format("string")), "hits")


def _judged(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def _groups(benchmark: DataFrame, item_bytes: int) -> tuple[Broadcast | None, Iterator[Broadcast]]:
    """The only group, or else None, and all groups."""
    groups = hold_items(benchmark, item_bytes=item_bytes)
    first, second = next(groups), next(groups, None)
    return (first if second is None else None), (g for g in chain([first, second], groups) if g is not None)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """For every row: words, hit words, items that occur, the verdict, and the hit spans in code points.

    Map-only over the texts; with several groups of items their hits are joined to the rows by the SHA-256
    of the text.  A null or empty text has no words and no hits; an empty benchmark
    hits nothing; an item without an id counts for hits and verdict and is not among the items;
    repeated rows give equal rows; other columns are not read.
    """
    only, groups = _groups(benchmark, item_bytes)
    text = F.col(text_col).cast("string")
    own = [F.col(id_col).alias("id"), *([] if only is not None else [F.sha2(text, 256).alias("key")])]
    rows = docs.select(F.struct(F.struct(*own).alias("own"), text.alias("text")).alias("row"))
    schema = _FOUND.format(rows.select("row.own").schema["own"].dataType.simpleString())
    if only is not None:
        found = in_arrow(rows, _pass(only, "own"), schema, _OWNER)
    else:
        hits = _by_text(rows, groups).withColumnRenamed("row", "key").drop("n_words")
        nothing = docs.sparkSession.sparkContext.broadcast(("", [], WINDOW))
        counted = in_arrow(rows, _pass(nothing, "own"), schema, _OWNER).select("row", "n_words", F.col("row.key").alias("key"))
        none = {c: F.coalesce(c, F.array().cast(hits.schema[c].dataType)) for c in ("items", "runs", "spans")}
        found = counted.join(hits, "key", "left").withColumns(none)
    return _judged(found).select(
        "row.id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "items", "spans"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns; one pass for each group of items.

    With one group there is no join; with several, contaminated texts are joined away by their SHA-256.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    only, groups = _groups(benchmark, item_bytes)
    if only is not None:
        found = in_arrow(rows, _pass(only), _FOUND.format(rows.schema["row"].dataType.simpleString()), _OWNER)
        return _judged(found).where(~F.col("contaminated")).select("row.*")
    gone = _judged(_by_text(rows, groups)).where("contaminated").select(F.col("row").alias("key"))
    return rows.withColumn("key", F.sha2("row.text", 256)).join(gone, "key", "left_anti").select("row.*")
