"""Token ids in binary files: a wavelet matrix per block of documents, one compressed file per shard.

Texts are encoded where they are read; only ids move, once, to the shard of their document id.  A
shard is a Parquet file of blocks; a block holds the document ids, their lengths and the wavelet
matrices of their ids, and answers access, count and occurrence queries by itself.  A block ends with
a document; a document longer than a block has several matrices in its block.  Spark's file commit
makes the files safe against lost executors.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, in_arrow, kept
from .textarrays import LOWER, NOT_SPACE, SLICE_BYTES, binaries, slices, stretches, words
from .wavelet import WaveletMatrix, build

END_ID = 1
#: Documents of a shard on average, and tokens of a matrix, after which a block is closed too (at a document's end).
SHARD_DOCS, BLOCK_TOKENS = 4096, 1 << 18
#: Shards at most; beyond it shards have more blocks.
MAX_SHARDS = 20_000
#: Shards in a group of the two-level running sum of tokens, and shards whose sums are broadcast.
GROUP_SHARDS, BROADCAST_SHARDS = 1000, 100_000
#: Bytes of text that are encoded at a time.
ENCODE_BYTES = 1 << 20
#: Distinct units of text whose ids a Python worker remembers before it drops the rarer half, and units of one library call.
REMEMBERED, JOINED = 200_000, 60
_OWNER = "token_files"

BLOCKS = (
    "shard int, block int, n_docs long, n_tokens long, bits int, ids binary, no_id binary, lengths binary,"
    " sizes array<int>, planes array<binary>, ranks array<binary>, zeros array<array<int>>"
)

# How the tokenizer splits a text (normalisers, then the pattern of its pieces).
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_END = "</w>"
#: First bytes of two-byte characters that are all letters, which composition and lower-casing leave letters
#: (U+00C0 to U+017F, U+0400 to U+047F), but for these three: no letters, or a letter and a mark when lower-cased.
_LETTERS, _NOT_LETTERS = (0xC3, 0xC4, 0xC5, 0xD0, 0xD1), ("\u00d7", "\u00f7", "\u0130")


class Encoder:
    """Ids of texts, as the library gives them, encoding a unit met often once.

    The tokenizer lower-cases, drops white space and cuts a text into letter runs, single digits and
    runs of other characters, each of which ends with a word-end token.  So a stretch between ASCII
    white space can be encoded by itself; one of ASCII and common Latin and Cyrillic letters is cut
    further into those units, its A-Z lower-cased.  Stretches with other characters, apostrophes,
    control characters or the first character of a special token stay whole.  A tokenizer that is not
    of this kind gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.by_unit = self._splits()
        self.ends_word = np.zeros(self.size, bool)
        self.ends_word[[k for t, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(_WORD_END)]] = True
        self.unit = np.full(256, 4, np.uint8)  # 0 space, 1 letters, 2 digits, 3 others of ASCII, 4 stays whole
        self.unit[[*_LETTERS, *range(0x80, 0xC0)]] = 1
        self.unit[0x21:0x7F] = 3
        self.unit[0x30:0x3A] = 2
        self.unit[0x41:0x5B] = self.unit[0x61:0x7B] = 1
        self.unit[[0x20, *range(0x09, 0x0E)]] = 0
        self.unit[[ord("'"), *(t.content.encode()[0] for t in self.tokenizer.get_added_tokens_decoder().values())]] = 4
        self.forget()

    def _splits(self) -> bool:
        own = json.loads(self.tokenizer.to_str())
        normal, pieces = own["normalizer"] or {}, own["pre_tokenizer"] or {}
        split = (pieces.get("pretokenizers") or [{}])[0]
        return (
            [n["type"] for n in normal.get("normalizers", [])] == _NORMALIZERS
            and split.get("pattern") == {"Regex": _PIECES} and split.get("behavior") == "Removed" and split.get("invert") is True
            and own["model"].get("end_of_word_suffix") == _WORD_END and not own["truncation"]
        )

    def forget(self) -> None:
        self.memory: dict[bytes, int] = {}
        self.at, self.n, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)
        self.met = np.zeros(0, np.int32)  # slices that had the unit

    def _forget_rare(self, most: int) -> None:
        """Keep the units met more than once, ``most`` of them at most, the oftenest."""
        held = np.sort(np.argsort(-self.met, kind="stable")[:most])
        held = held[self.met[held] > 1]
        keys, n, ends = list(self.memory), self.n[held], np.cumsum(self.n[held])
        self.pool = self.pool[np.repeat(self.at[held] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        self.memory = {keys[k]: place for place, k in enumerate(held.tolist())}
        self.at, self.n, self.met = ends - n, n, self.met[held] // 2

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain units, one after the other, and how many each has: they end with word-end tokens."""
        out, n = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        groups = [units[k : k + JOINED] for k in range(0, len(units), JOINED)]
        for group, ids in zip(groups, self._ids([b" ".join(g).decode() for g in groups]), strict=True):
            own = np.array(ids, self.kind)
            last = np.flatnonzero(self.ends_word[own])
            if len(last) == len(group) and last[-1] == len(own) - 1:
                out.append(own)
                n.append(np.diff(last, prepend=-1))
            else:
                alone = self._ids([u.decode() for u in group])
                out.append(np.fromiter(chain.from_iterable(alone), self.kind))
                n.append(np.array([len(x) for x in alone], np.int64))
        return np.concatenate(out), np.concatenate(n)

    def _learn(self, plain: list[bytes], whole: list[bytes]) -> None:
        ids, n = self._of_units(plain)
        others = self._ids([w.decode() for w in whole])
        n = np.concatenate([n, np.array([len(x) for x in others], np.int64)])
        self.memory.update(zip(plain + whole, range(len(self.n), len(self.n) + len(n)), strict=True))
        self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        self.met = np.concatenate([self.met, np.zeros(len(n), np.int32)])
        self.pool = np.concatenate([self.pool, ids, np.fromiter(chain.from_iterable(others), self.kind)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and their bounds."""
        if not self.by_unit:
            whole = data.tobytes()
            own = [np.array([*ids, END_ID], self.kind) for ids in self._ids([whole[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])]
            return np.concatenate([np.zeros(0, self.kind), *own]), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        if len(data) > 2 * SLICE_BYTES and len(offsets) == 2:  # a very long text: in stretches that end at white space
            parts = [self._encode(data[a:b], np.array([0, b - a]))[0][:-1] for a, b in stretches(data, NOT_SPACE)]
            ids = np.concatenate([*parts, np.array([END_ID], self.kind)])
            return ids, np.array([0, len(ids)])
        return self._encode(data, offsets)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, _ = words(data, offsets, NOT_SPACE)
        kind, filled = self.unit[data], NOT_SPACE[data]
        for a, b in (c.encode() for c in _NOT_LETTERS):
            kind[:-1][(data[:-1] == a) & (data[1:] == b)] = 4
        edge = np.zeros(len(data) + 1, np.int8)
        hard = np.concatenate([[0], np.cumsum(kind == 4, dtype=np.int32)])
        hard = hard[ends] > hard[starts]
        edge[starts[hard]] += 1
        edge[ends[hard]] -= 1
        kept = np.cumsum(edge[:-1], dtype=np.int8).view(bool)  # bytes of stretches that stay whole
        first = np.zeros(len(data), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        first &= filled & ~kept
        first[starts] = True
        at = np.flatnonzero(first)
        bounds = np.searchsorted(at, offsets)
        low = np.where(kept, data, LOWER[data])[filled]
        before = np.concatenate([[0], np.cumsum(filled, dtype=np.int32)])
        units = binaries(low, np.append(before[at], len(low))).dictionary_encode()
        codes, keys = units.indices.to_numpy(), _bytes(units.dictionary)
        whole = np.zeros(len(keys), bool)
        whole[codes] = kept[at]
        if len(self.memory) > REMEMBERED:
            self._forget_rare(REMEMBERED // 2)
        get = self.memory.get
        slot = np.array([get(k, -1) for k in keys], np.int64)
        if (new := slot < 0).any():
            self._learn([keys[k] for k in np.flatnonzero(new & ~whole).tolist()], [keys[k] for k in np.flatnonzero(new & whole).tolist()])
            slot[new] = [get(keys[k]) for k in np.flatnonzero(new).tolist()]
        self.met[slot] += 1
        lengths = np.insert(self.n[slot][codes], bounds[1:], 1)
        begin = np.insert(self.at[slot][codes], bounds[1:], len(self.pool))
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = np.append(self.pool, self.kind(END_ID))[np.repeat(begin - total[:-1], lengths) + np.arange(total[-1])]
        return ids, total[bounds + np.arange(len(bounds))]


def _bytes(column: pa.LargeBinaryArray) -> list[bytes]:
    _, offsets, data = column.buffers()
    at, raw = np.frombuffer(offsets, np.int64)[: len(column) + 1].tolist(), data.to_pybytes()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def encoder(path: str) -> Encoder:
    """Made once in each Python worker, and kept until a task of another operator runs there."""
    own = kept(_OWNER)
    if path not in own:
        own[path] = Encoder(path)
    return own[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limits: tuple[int, ...] = (), nameless: int = 1) -> DataFrame:
    """(id, shard, tokens): the little-endian ids of every row's whole text with the end id.

    A row's shard is the number of ``limits`` below its id (ascending); rows without an id are dealt
    by their text to ``nameless`` shards after those.  A null text counts as empty.
    """
    cuts = np.array(limits, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text"), ENCODE_BYTES):
                ids, bounds = own.encode(data, offsets)
                width = ids.itemsize
                raw = ids.astype(ids.dtype.newbyteorder("<"), copy=False).tobytes()
                tokens = [raw[a * width : b * width] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                own_ids = batch.column("id").slice(lo, hi - lo)
                shard = np.searchsorted(cuts, pc.fill_null(own_ids, 0).to_numpy(), "left")
                for k in np.flatnonzero(pc.is_null(own_ids).to_numpy(zero_copy_only=False)).tolist():
                    shard[k] = len(cuts) + 1 + zlib.crc32(tokens[k]) % nameless
                yield pa.RecordBatch.from_pydict({"id": own_ids, "shard": pa.array(shard, pa.int32()), "tokens": pa.array(tokens, pa.binary())})
                del ids, raw, tokens

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return in_arrow(rows, run, "id long, shard int, tokens binary", _OWNER)


def _block(shard: int, block: int, ids: list[int | None], tokens: list[np.ndarray], bits: int, size: int) -> dict:
    every = np.concatenate(tokens)
    made = [build(every[k : k + size], bits) for k in range(0, len(every), size)]
    return {
        "shard": shard, "block": block, "n_docs": len(ids), "n_tokens": len(every), "bits": bits,
        "ids": np.array([i or 0 for i in ids], "<i8").tobytes(), "no_id": np.packbits([i is None for i in ids], bitorder="little").tobytes(),
        "lengths": np.array([len(t) for t in tokens], "<i8").tobytes(), "sizes": [min(size, len(every) - k) for k in range(0, len(every), size)],
        "planes": [m[0] for m in made], "ranks": [m[1] for m in made], "zeros": [m[2] for m in made],
    }


def matrices(row: dict) -> Iterator[WaveletMatrix]:
    """The matrices of a block, in the order of its tokens."""
    for n, planes, ranks, zeros in zip(row["sizes"], row["planes"], row["ranks"], row["zeros"], strict=True):
        yield WaveletMatrix(n, row["bits"], planes, ranks, zeros)


_ARROW_BLOCKS = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bits", pa.int32()),
    ("ids", pa.binary()), ("no_id", pa.binary()), ("lengths", pa.binary()), ("sizes", pa.list_(pa.int32())),
    ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())), ("zeros", pa.list_(pa.list_(pa.int32()))),
])


def write_token_files(docs: DataFrame, where: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the ids of ``docs`` to the folder ``where``, shards and documents in ascending id order.

    Shard limits are quantiles of the ids, read from that column alone.  Rows without an id come
    last, in shards of their own; repeated rows stand side by side; an empty table gives a folder
    without blocks.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    bits = max(1, int(encoder(path).size - 1).bit_length())
    width = np.dtype(encoder(path).kind).str.replace(">", "<")
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    rows, named = ids.agg(F.count("*"), F.count("id")).first()
    shards, nameless = (min(MAX_SHARDS, max(1, -(-n // shard_docs))) for n in (named, rows - named))
    limits = sorted({int(x) for x in ids.approxQuantile("id", [k / shards for k in range(1, shards)], 0.25 / shards)}) if shards > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids, held, size, number, at = [], [], 0, 0, None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                yield pa.RecordBatch.from_pylist([_block(at, number, held_ids, held, bits, block_tokens)], schema=_ARROW_BLOCKS)

        for batch in batches:
            for s, i, raw in zip(batch.column("shard").to_pylist(), batch.column("id").to_pylist(), batch.column("tokens"), strict=True):
                if held and (s != at or size >= block_tokens):
                    yield from close()
                    held_ids, held, size, number = [], [], 0, number + 1 if s == at else 0
                at = s
                held_ids.append(i)
                held.append(np.frombuffer(raw.as_buffer(), width))
                size += len(held[-1])
        yield from close()

    dealt = encode(docs, path, id_col, text_col, tuple(limits), nameless).repartitionById(len(limits) + 1 + nameless, F.col("shard"))
    blocks = in_arrow(dealt.sortWithinPartitions("shard", F.col("id").asc_nulls_last(), "tokens"), run, BLOCKS, _OWNER)
    blocks.write.option("compression", "zstd").mode("overwrite").parquet(where)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):  # a block at a time
            row = batch.slice(k, 1).to_pylist()[0]
            lengths = np.frombuffer(row["lengths"], "<i8")
            ends = np.cumsum(lengths)
            missing = np.unpackbits(np.frombuffer(row["no_id"], np.uint8), count=len(lengths), bitorder="little").astype(bool)
            crc, at, seen = [0] * len(lengths), 0, 0
            for matrix in matrices(row):
                tokens = matrix.tokens().astype("<u4")
                for d in range(at, len(ends)):  # a document may go on in the next matrix
                    begin, end = int(ends[d] - lengths[d]) - seen, int(ends[d]) - seen
                    if begin >= len(tokens):
                        break
                    crc[d] = zlib.crc32(tokens[max(0, begin) : end], crc[d])
                    at = d + (end <= len(tokens))
                seen += len(tokens)
            yield pa.RecordBatch.from_pydict({"id": pa.array(np.frombuffer(row["ids"], "<i8"), mask=missing), "start": row["start"] + ends - lengths, "n_tokens": lengths, "ids_crc32": pa.array(crc, pa.int64())})


def read_token_files(spark: SparkSession, where: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files alone.

    Starts come from the blocks' token counts by a running sum in two levels: within groups of
    shards in parallel, then over the groups.
    """
    blocks = spark.read.schema(BLOCKS).parquet(where)
    sizes = blocks.select("shard", "block", "n_tokens")
    group = F.floor(F.col("shard") / GROUP_SHARDS)
    groups = sizes.groupBy(group.alias("group")).agg(F.sum("n_tokens").alias("n"))
    groups = groups.withColumn("base", F.sum("n").over(Window.orderBy("group")) - F.col("n")).drop("n")
    within = Window.partitionBy("group").orderBy("shard", "block")
    starts = sizes.withColumn("group", group).withColumn("own", F.sum("n_tokens").over(within) - F.col("n_tokens")).join(F.broadcast(groups), "group")
    starts = starts.select("shard", "block", (F.col("base") + F.col("own")).alias("start"))
    if sizes.count() <= BROADCAST_SHARDS:
        starts = F.broadcast(starts)
    placed = blocks.join(starts, ["shard", "block"]).select("bits", "ids", "no_id", "lengths", "sizes", "planes", "ranks", "zeros", "start")
    return in_arrow(placed, _decode, "id long, start long, n_tokens long, ids_crc32 long", _OWNER)


def token_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``docs`` to token files in the scratch folder and return what the files say of each row."""
    scratch = Scratch(docs.sparkSession, "tokens")
    write_token_files(docs, scratch.path("files"), path)
    return read_token_files(docs.sparkSession, scratch.path("files")).withColumnRenamed("id", "doc_id")
