"""Quality classifier: hashed word n-gram logistic regression, fitted by FTRL, scored as sparse dot products.

Words are maximal runs of letters/digits or of one kind of other printable character, so that
``word###`` is the word and the symbol run.  Features of a text are the hashed unigrams and bigrams
of its lower-cased words and the hashed unigrams and bigrams of the words' shapes (case, digits,
which symbol, and whether a word repeats the one before); each has its share of the text's words
as value.  Only the text is an input of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, in_arrow
from .linear import Ftrl, fit, fit_in_a_task, sigmoid
from .textarrays import LOWER, NOT_SPACE, U64, mix, slices, span_hashes, stretches, sums_by

BITS = 18
THRESHOLD = 0.7
#: At most so many labelled rows are fitted: those whose hashed id is smallest.
FIT_ROWS = 6000
#: Bytes of a text up to which it is taken into a fitting sample.
SAMPLE_BYTES = 1 << 15

_KIND = np.full(256, 3, np.uint8)  # 0 space, 1 letters and digits, 2 marks within prose, 3 symbols
_KIND[:33] = 0
_KIND[127] = 0
_KIND[0x30:0x3A] = _KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = 1
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 2
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kind of each byte, and starts and ends of the words."""
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change |= edge
    cuts = np.flatnonzero(change)
    starts, ends = cuts[:-1], cuts[1:]
    some = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    return kind, starts[some], ends[some]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """[(hashed feature numbers, bounds by text)], one entry per kind of feature, and words per text."""
    kind, starts, ends = _spans(data, offsets)
    bounds = np.searchsorted(starts, offsets)
    word = span_hashes(LOWER[data], starts, ends) if len(starts) else np.zeros(0, U64)
    upper, digit = (np.concatenate([[0], np.cumsum(x[data])]) for x in (_UPPER, _DIGIT))
    n = ends - starts
    ups = upper[ends] - upper[starts]
    shape = np.where(ups == 0, 0, np.where((ups == n) & (n > 1), 2, 1)) + 4 * (digit[ends] > digit[starts])
    same = np.zeros(len(word), bool)
    same[1:] = word[1:] == word[:-1]
    shape = np.where(kind[starts] == 1, shape, 0).astype(U64) + U64(16) * same
    symbol = kind[starts] > 1
    shape = np.where(symbol, word, shape + U64(101))  # a symbol run is its own shape
    inner = np.ones(len(word), bool)
    inner[bounds[1:-1][bounds[1:-1] < len(word)]] = False
    inner[:1] = False
    at = np.flatnonzero(inner)
    pair_bounds = np.searchsorted(at, bounds)
    out = []
    for salt, values in ((1, word), (2, shape)):
        one = mix(values + U64(salt * 0x632BE59BD9B4E019 % (1 << 64)))
        two = mix(one[at] + U64(3) * values[at - 1])
        out += [(one >> U64(64 - BITS), bounds), (two >> U64(64 - BITS), pair_bounds)]
    return [(idx.astype(np.int64), b) for idx, b in out], np.diff(bounds)


def margins(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The margin of each text, the same however a very long one is cut into stretches."""
    n = len(offsets) - 1
    if n == 1 and len(parts := [*stretches(data, NOT_SPACE)]) > 1:
        return weights[-1] + _long_sum(data, parts, weights)
    kinds, n_words = features(data, offsets)
    return weights[-1] + sum(sums_by(bounds, weights[idx]) for idx, bounds in kinds) / np.maximum(n_words, 1)


def _long_sum(data: np.ndarray, parts: list[tuple[int, int]], weights: np.ndarray) -> np.ndarray:
    """The mean weight of a text's features, stretch by stretch.

    A stretch is read with the two words before it: they make its first pair and tell the shape of the
    word before it, and are not counted again.
    """
    total, n_words, before = 0.0, 0, []
    for a, b in parts:
        at = before[0] if before else a
        own = data[at:b]
        kinds, (count,) = features(own, np.array([0, b - at]))
        carried = len(before)
        for k, (idx, _) in enumerate(kinds):
            total += weights[idx[max(0, carried - 1) if k % 2 else carried :]].sum()
        n_words += count - carried
        before = (_spans(own, np.array([0, b - at]))[1][-2:] + at).tolist()
    return np.array([total / max(n_words, 1)])


def training_rows(column: pa.Array, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    rows = []
    for lo, hi, data, offsets in slices(column):
        kinds, n = features(data, offsets)
        for k in range(hi - lo):
            idx = np.concatenate([i[b[k] : b[k + 1]] for i, b in kinds])
            at, count = np.unique(idx, return_counts=True)
            rows.append((at, count / max(1, n[k]), int(labels[lo + k])))
    return rows


def _crc(i: Column) -> Column:
    return F.crc32(i.cast("string").cast("binary")) % 4


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, row_bytes: int, held_out: bool = False) -> DataFrame:
    """(id, turn, y, text): one row for each of at most ``rows`` labelled ids, those of smallest hash.

    The ids are chosen from ``labels`` alone, so only their texts are read.  Null ids, null labels and
    labels other than 0 and 1 do not count; of several labels of an id the largest counts, of several
    texts the smallest, and texts of more than ``row_bytes`` bytes are not taken: the sample has ``rows``
    times ``row_bytes`` bytes at most.  With ``held_out`` ids of the held-out quarter are left out.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    if held_out:
        known = known.where(_crc(F.col("id")) != 2)
    chosen = known.groupBy("id").agg(F.max("y").alias("y")).withColumn("turn", F.xxhash64("id")).orderBy("turn", "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= row_bytes)
    return texts.join(F.broadcast(chosen), "id").groupBy("id", "turn", "y").agg(F.min("text").alias("text"))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = FIT_ROWS, row_bytes: int = SAMPLE_BYTES, how: Ftrl = Ftrl()) -> np.ndarray:
    """Weights from a sample of at most ``limit`` labelled rows outside the held-out quarter, fitted in one task."""
    rows = sample(docs, labels, id_col, text_col, label_col, limit, row_bytes, held_out=True)
    return fit_in_a_task(rows, lambda t: [fit(training_rows(t.column("text"), t.column("y").to_numpy()), 1 << BITS, how)])[0]


def _score(batch: pa.RecordBatch, weights: np.ndarray) -> dict:
    score = np.empty(batch.num_rows)
    for lo, hi, data, offsets in slices(batch.column("text")):
        score[lo:hi] = sigmoid(margins(data, offsets, weights))
    return {"id": batch.column("id"), "score": score}


def score_quality(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability of label 1 for every row, from its whole text; null counts as empty.

    Weights travel with the task: 2**18 + 1 doubles, whatever the input.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), lambda batch, w: _score(batch, w.value), f"id {kind}, score double", held)


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` as doc_id, held_out, score and predicted (score >= ``threshold``).

    Nulls and empty texts get the score of a text without words; repeated rows get equal rows;
    a row without a doc_id is scored and not held out; an empty ``labels`` gives 0.5 for all.
    Columns other than doc_id and text are not read.
    """
    weights = fit_quality(docs, labels)
    scored = score_quality(docs, weights)
    return scored.select(
        F.col("id").alias("doc_id"),
        F.coalesce(_crc(F.col("id")) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns; one pass, no join."""
    held = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels))

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for lo, hi, data, offsets in slices(batch.column("text")):
                keep[lo:hi] = sigmoid(margins(data, offsets, held.value)) >= threshold
            yield batch.filter(pa.array(keep))

    return in_arrow(docs, run, docs.schema)
