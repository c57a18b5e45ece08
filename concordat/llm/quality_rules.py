"""Quality rules: countable rules, and a calibrated n-gram model against a fixed threshold.

The model is a logistic regression over hashed word n-grams (those of the quality classifier) and
hashed character n-grams of four and six bytes, fitted on labelled rows by FTRL; its margin is
calibrated on labelled rows that were not fitted (Platt scaling).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality_classifier as ngrams
from .common import arrow_map, ship
from .linear import Ftrl, calibrate, fit, fit_in_a_task, sigmoid
from .textarrays import NOT_SPACE, U64, mix, of_text, run_codes, slices, stretches, sums_by

# The base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEATED_PERCENT = 10, 5, 20
#: The calibrated probability of a good text below which the model rejects.
THRESHOLD = 0.5
#: Labelled rows of the sample, of which every third calibrates and the others are fitted.
SAMPLE_ROWS, CALIBRATE_EVERY = 6000, 3
CHAR_BITS, CHAR_SIZES = 18, (4, 6)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_POINT = (np.arange(256) & 0xC0) != 0x80
_IN_LINE = np.arange(256) != 10


@dataclass(frozen=True)
class Model:
    """Weights (word part, character part, bias) and the calibration of their margin."""

    weights: np.ndarray
    slope: float
    intercept: float


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The countable rules' figures for each text; lines and words are told apart by their bytes."""
    codes, bounds = run_codes(data, offsets, NOT_SPACE)
    n = len(offsets) - 1
    n_words = np.diff(bounds)
    points = sum(sums_by(np.clip(offsets - a, 0, b - a), _POINT[data[a:b]] & NOT_SPACE[data[a:b]]) for a, b in [*stretches(data, NOT_SPACE)] or [(0, 0)])
    out = {"n_words": n_words, "word_chars": points, "n_symbols": sums_by(offsets, _SYMBOL[data])}

    lines, l_bounds = run_codes(data, offsets, _IN_LINE, NOT_SPACE)
    text = of_text(l_bounds)
    _, first = np.unique(text * (int(lines.max(initial=0)) + 1) + lines, return_index=True)
    out["n_dup_lines"] = np.bincount(text, minlength=n) - np.bincount(text[first], minlength=n)

    repeated = np.zeros(len(codes) + 1, np.int8)
    if len(codes) >= WINDOW:
        text = of_text(bounds)
        last = len(codes) - WINDOW + 1
        whole = np.flatnonzero(text[:last] == text[WINDOW - 1 :])
        twice = _twice(codes, text, whole)
        for k in range(WINDOW):
            repeated[twice + k] = 1
    out["n_repeat_words"] = sums_by(bounds, repeated[:-1])
    return out


def _twice(codes: np.ndarray, text: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Those of the windows that begin at ``whole`` that stand in their text twice or more.

    Windows are sorted by a hash and neighbours compared word by word; should two different windows
    share a hash, they are sorted by their words.
    """
    window = text[whole].astype(U64)
    for k in range(WINDOW):
        window = mix(window * U64(0x632BE59BD9B4E019) + codes[whole + k].astype(U64))
    at = whole[np.argsort(window, kind="stable")]
    window.sort()
    equal = _same_windows(codes, text, at)
    if ((window[1:] == window[:-1]) & ~equal).any():
        at = whole[np.lexsort([codes[whole + k] for k in range(WINDOW)] + [text[whole]])]
        equal = _same_windows(codes, text, at)
    return np.concatenate([at[1:][equal], at[:-1][equal]])


def _same_windows(codes: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    equal = text[at[1:]] == text[at[:-1]]
    for k in range(WINDOW):
        equal &= codes[at[1:] + k] == codes[at[:-1] + k]
    return equal


def char_features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(hashed numbers, bounds by text)] of the byte n-grams of each size within texts."""
    out, text = [], of_text(offsets)
    for size in CHAR_SIZES:
        last = max(0, len(data) - size + 1)
        value = np.zeros(last, U64)
        for k in range(size):
            value |= data[k : k + last].astype(U64) << U64(8 * k)
        inside = text[:last] == text[size - 1 : size - 1 + last]
        at = np.flatnonzero(inside)
        out.append(((mix(value[at] + U64(size * 0x632BE59BD9B4E019 % (1 << 64))) >> U64(64 - CHAR_BITS)).astype(np.int64), np.searchsorted(at, offsets)))
    return out


def margins(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The margin of each text, the same however a very long one is cut into stretches."""
    cut = 1 << ngrams.BITS
    total = ngrams.margins(data, offsets, np.append(weights[:cut], weights[-1]))
    own, n = weights[cut:-1], len(offsets) - 1
    sums, grams = np.zeros((len(CHAR_SIZES), n)), np.zeros((len(CHAR_SIZES), n), np.int64)
    for a, b in stretches(data, NOT_SPACE) if n == 1 else [(0, len(data))]:
        at = max(0, a - max(CHAR_SIZES) + 1)  # with the bytes before, whose grams end in this stretch
        for k, (idx, bounds) in enumerate(char_features(data[at:b], np.clip(offsets - at, 0, b - at))):
            known = max(0, a - at - CHAR_SIZES[k] + 1)  # those that end before it
            sums[k] += sums_by(bounds, own[idx])
            grams[k] += np.diff(bounds)
            if known:
                sums[k] -= own[idx[:known]].sum()
                grams[k] -= min(known, len(idx))
    return total + (sums / np.maximum(grams, 1)).sum(axis=0)


def _rows(column: pa.Array, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    rows = ngrams.training_rows(column, labels)
    for lo, hi, data, offsets in slices(column):
        kinds = char_features(data, offsets)
        for k in range(hi - lo):
            at, x, y = rows[lo + k]
            for idx, b in kinds:
                own, count = np.unique(idx[b[k] : b[k + 1]], return_counts=True)
                at, x = np.append(at, own + (1 << ngrams.BITS)), np.append(x, count / max(1, b[k + 1] - b[k]))
            at, back = np.unique(at, return_inverse=True)
            rows[lo + k] = at, np.bincount(back, x, len(at)), y
    return rows


def fit_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS, calibrate_every: int = CALIBRATE_EVERY, sample_bytes: int = ngrams.SAMPLE_BYTES, how: Ftrl = Ftrl(),
) -> Model:
    """The model, from at most ``sample_rows`` labelled rows (see :func:`sample` of the classifier).

    In the order of their hashed ids every ``calibrate_every``-th of them calibrates and the others
    are fitted.  Without rows the model says one half for all texts.
    """
    ship(docs.sparkSession)
    rows = ngrams.sample(docs, labels, id_col, text_col, label_col, sample_rows, sample_bytes)
    size = (1 << ngrams.BITS) + (1 << CHAR_BITS)

    def both(rows: pa.Table) -> list[np.ndarray]:
        y = rows.column("y").to_numpy()
        held = np.arange(len(y)) % calibrate_every == calibrate_every - 1
        weights = fit(_rows(rows.filter(pa.array(~held)).column("text"), y[~held]), size, how)
        m = np.concatenate([margins(data, offsets, weights) for _, _, data, offsets in slices(rows.filter(pa.array(held)).column("text"))] or [np.zeros(0)])
        return [weights, np.array(calibrate(m, y[held]))]

    weights, (slope, intercept) = fit_in_a_task(rows, both)
    return Model(weights, float(slope), float(intercept))


def _apply(batch: pa.RecordBatch, model: Model, threshold: float) -> dict:
    out: dict[str, list] = {}
    for _, _, data, offsets in slices(batch.column("text")):
        part = counts(data, offsets)
        part["base_failed"] = (part["n_words"] < MIN_WORDS) | (100 * part["n_repeat_words"] > MAX_REPEATED_PERCENT * part["n_words"])
        part["probability"] = sigmoid(model.slope * margins(data, offsets, model.weights) + model.intercept)
        part["kept"] = ~part["base_failed"] & (part["probability"] >= threshold)
        for key, value in part.items():
            out.setdefault(key, []).append(value)
    return {"id": batch.column("id")} | {k: pa.array(np.concatenate(v)) for k, v in out.items()}


def apply_rules(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """For every row: the counts, whether a base rule fails, the model's probability, and the verdict.

    Map-only; the broadcast model has a fixed size.  A null or empty text has no words and fails;
    repeated rows give equal rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)
    return arrow_map(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")),
        lambda batch, m, t: _apply(batch, m.value, t),
        f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean",
        held,
        threshold,
    )
