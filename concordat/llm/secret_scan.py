"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

A string that a byte-pair vocabulary cannot compress is random: its characters per token are few.
Long runs of key characters are measured that way, after the base spans, known digests (hexadecimal
strings of the usual digest lengths) and identifiers (UUIDs, runs without letters) are set aside: as a
whole, or else by their parts between separators and by windows that slide over the tokens.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .textarrays import slices, stretches, words

# The base patterns, over UTF-8 bytes (all they match is ASCII).
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")

_KEY_BYTE = np.zeros(256, bool)
_KEY_BYTE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
#: Characters of a run that is measured, and characters per token below which it counts as random.
MIN_RANDOM, CHARS_PER_TOKEN = 20, 2.1
#: Letters and digits in a row, themselves below that ratio, that a window needs, and a whole without digits.
#: Letters of one case in a row must be MIN_RANDOM: shorter ones are words of an identifier.
MIN_STRETCH = 8
_DIGEST = rb"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
_UUID = rb"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_KNOWN = re.compile(rb"(?i)(?<![0-9a-z])(?:" + _UUID + rb"|" + _DIGEST + rb")(?![0-9a-z])")
_PART = re.compile(rb"[A-Za-z0-9+]+")
_STRETCH = re.compile(rb"[A-Za-z0-9]{%d,}" % MIN_STRETCH)
_NUMBER = re.compile(rb"(?<![A-Za-z0-9])[0-9]+(?![A-Za-z0-9])")
_PIECE = 4096  # long runs are measured in pieces, all of them


@cache
def vocabulary(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Measured:
    """A run of key characters with the ends of its tokens.

    The vocabulary's pattern keeps letters, digits and other characters apart, so a separator ends a token.
    """

    def __init__(self, run: bytes, path: str):
        encoding, text = vocabulary(path), run.decode()
        sizes = [len(encoding.decode_single_token_bytes(t)) for k in range(0, len(text), _PIECE) for t in encoding.encode_ordinary(text[k : k + _PIECE])]
        self.run, self.ends = run, np.concatenate([[0], np.cumsum(sizes)])

    def low(self, start: int, end: int) -> bool:
        tokens = np.searchsorted(self.ends, end) - np.searchsorted(self.ends, start)
        return end - start < CHARS_PER_TOKEN * tokens

    def _stretch(self, start: int, end: int) -> bool:
        return any(self.low(*m.span()) and (len(m[0]) >= MIN_RANDOM or not m[0].isalpha() or not (m[0].isupper() or m[0].islower())) for m in _STRETCH.finditer(self.run, start, end))

    def whole(self, start: int, end: int) -> bool:
        own = self.run[start:end]
        if not re.search(rb"[A-Za-z]", own) or not self.low(start, end):
            return False
        return bool(re.search(rb"[0-9]", own)) or self._stretch(start, end)

    def windows(self) -> list[tuple[int, int]]:
        """Shortest runs of tokens of MIN_RANDOM characters under the ratio, from every token on; none crosses a number."""
        after = np.searchsorted(self.ends, self.ends + MIN_RANDOM)
        first = np.flatnonzero(after < len(self.ends))
        last = after[first]
        number, letter = np.zeros(len(self.run) + 1, np.int64), np.zeros(len(self.run) + 1, np.int64)
        for m in _NUMBER.finditer(self.run):
            number[m.start() + 1 : m.end() + 1] = 1
        letter[1:] = np.frombuffer(self.run, np.uint8) >= 65
        letter[1:] -= np.frombuffer(self.run, np.uint8) == 95  # _
        number, letter = np.cumsum(number), np.cumsum(letter)
        starts, ends = self.ends[first], self.ends[last]
        kept = (ends - starts < CHARS_PER_TOKEN * (last - first)) & (number[ends] == number[starts]) & (letter[ends] > letter[starts])
        return [(s, e) for s, e in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True) if self._stretch(s, e)]

    def trimmed(self, start: int, end: int) -> tuple[int, int]:
        """The span without words at its ends, where the rest is long enough."""
        parts = [m.span() for m in _PART.finditer(self.run, start, end)]
        lo, hi = 0, len(parts) - 1
        while lo < hi and not self.low(*parts[lo]) and end - parts[lo + 1][0] >= MIN_RANDOM:
            lo += 1
            start = parts[lo][0]
        while lo < hi and not self.low(*parts[hi]) and parts[hi - 1][1] - start >= MIN_RANDOM:
            hi -= 1
            end = parts[hi][1]
        return start, end


def _joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, those that overlap or touch as one."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _between(start: int, end: int, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of a span is left beside disjoint sorted spans, where it is long enough."""
    cuts = [start, *(min(max(x, start), end) for span in gone for x in span), end]
    return [(s, e) for s, e in zip(cuts[::2], cuts[1::2], strict=True) if e - s >= MIN_RANDOM]


def random_spans(run: bytes, path: str) -> list[tuple[int, int]]:
    """(start, end) of the random strings in a run of key characters, in order and apart."""
    out = []
    for start, end in _between(0, len(run), [m.span() for m in _KNOWN.finditer(run)]):
        own = _Measured(run[start:end], path)
        if own.whole(0, end - start):
            out.append((start, end))
            continue
        parts = [m.span() for m in _PART.finditer(own.run) if m.end() - m.start() >= MIN_RANDOM]
        found = _joined_spans([s for s in parts if own.whole(*s)] + own.windows())
        out += [(start + s, start + e) for s, e in (own.trimmed(*span) for span in found)]
    return out


def is_random(run: bytes, path: str) -> bool:
    return random_spans(run, path) == [(0, len(run))]


def base_spans(text: bytes, lowered: bytes, long_run: bool) -> list[tuple[int, int, str]]:
    """(start, kind number, end) in bytes; ``long_run``: some run of key characters has 20 or more."""
    out = []
    if any(k in lowered for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if long_run:  # a hexadecimal run of 32 lies in one
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= MIN_HEX]
    return sorted(out)


def _in_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """Byte spans in code points: each byte that does not continue a character starts one."""
    if not spans:
        return []
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(KINDS[kind], int(before[start]), int(before[end])) for start, kind, end in spans]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _scan(batch: pa.RecordBatch, path: str) -> dict:
    out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")}
    for lo, hi, data, offsets in slices(batch.column("text")):
        found = []
        for x, y in stretches(data, _KEY_BYTE) if hi - lo == 1 else [(0, len(data))]:
            own_starts, own_ends, _ = words(data[x:y], np.clip(offsets - x, 0, y - x), _KEY_BYTE)
            long = own_ends - own_starts >= MIN_RANDOM
            found.append((x + own_starts[long], x + own_ends[long]))
        starts, ends = (np.concatenate([np.zeros(0, np.int64), *side]) for side in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        cuts = np.searchsorted(starts, offsets)
        whole = data.tobytes()
        for k in range(hi - lo):
            text = whole[offsets[k] : offsets[k + 1]]
            a, b = cuts[k], cuts[k + 1]
            base = base_spans(text, text.lower(), b > a)
            gone = _joined_spans([(s, e) for s, _, e in base])
            reach = [e for _, e in gone]
            begins = [s for s, _ in gone]
            more = []
            for s, e in zip((starts[a:b] - offsets[k]).tolist(), (ends[a:b] - offsets[k]).tolist(), strict=True):
                for lo_, hi_ in _between(s, e, gone[bisect_right(reach, s) : bisect_right(begins, e)]):
                    more += [(lo_ + x, 3, lo_ + y) for x, y in random_spans(text[lo_:hi_], path)]
            points = _in_points(text, base)
            every = _in_points(text, sorted(base + more)) if more else points
            counts = [sum(kind == n for _, kind, _ in base) for n in range(3)]
            for key, value in zip(out, [*counts, len(more), hashlib.sha256(_joined(points).encode()).hexdigest(), _joined(every)], strict=True):
                out[key].append(value)
    kinds = [pa.int64()] * 4 + [pa.string()] * 2
    return {"id": batch.column("id")} | {k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)}


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """For every row: counts by kind, the digest of the base spans, and all spans as kind:start:end.

    Offsets are code points, the end exclusive.  Map-only.  A null or empty text has no spans (the
    digest is that of the empty string); repeated rows give equal rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")),
        _scan,
        f"id {kind}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string",
        vocabulary_path or public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )
