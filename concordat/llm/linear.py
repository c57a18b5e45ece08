"""Logistic regression over hashed features: FTRL-proximal fitting and sparse scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow


@dataclass(frozen=True)
class Ftrl:
    """Parameters of follow-the-regularised-leader (McMahan et al., 2013)."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    epochs: int = 3
    seed: int = 7


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, how: Ftrl = Ftrl()) -> np.ndarray:
    """Weights from (distinct feature numbers, values, label 0/1) rows; the last weight is the bias.

    Each epoch visits the rows in another order drawn from ``seed``, so a rerun gives the same
    weights.  No rows give zero weights.
    """
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    order = np.random.default_rng(how.seed)
    for _ in range(how.epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, size), np.append(x, 1.0)
            zs, ns = z[at], n[at]
            now = np.where(np.abs(zs) <= how.l1, 0.0, (np.sign(zs) * how.l1 - zs) / ((how.beta + np.sqrt(ns)) / how.alpha + how.l2))
            g = (sigmoid(now @ x) - y) * x
            step = (np.sqrt(ns + g * g) - np.sqrt(ns)) / how.alpha
            z[at] += g - step * now
            n[at] = ns + g * g
    live = np.abs(z) > how.l1
    w[live] = (np.sign(z[live]) * how.l1 - z[live]) / ((how.beta + np.sqrt(n[live])) / how.alpha + how.l2)
    return w


def fit_in_a_task(sample: DataFrame, fit_rows: Callable[[pa.Table], list[np.ndarray]]) -> list[np.ndarray]:
    """``fit_rows`` of a bounded sample, run in one task; only its arrays reach the driver.

    The caller bounds the sample's rows and bytes; their order is settled by ``turn`` and id, so that
    a rerun or a repeated task gives the same arrays.
    """
    none = pa.table({n: pa.array([], pa.string() if n == "text" else pa.int64()) for n in sample.columns})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        table = pa.Table.from_batches(rows) if rows else none
        found = fit_rows(table.sort_by([("turn", "ascending"), ("id", "ascending")]))
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(len(found)), pa.int32()), "value": [x.astype("<f8").tobytes() for x in found]})

    got = in_arrow(sample.repartition(1), run, "part int, value binary").collect()
    if not got:  # Spark runs no task over a table that it knows to be empty
        return fit_rows(none)
    return [np.frombuffer(r["value"], "<f8") for r in sorted(got, key=lambda r: r["part"])]


def calibrate(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt scaling: slope and intercept of sigmoid(a * margin + b), by Newton steps.

    Smoothed targets and a small ridge keep the slope finite on separable rows; it is at least
    0.1, so that the order of the scores is kept.  One class only: the identity.
    """
    positive = int(labels.sum())
    if positive in (0, len(labels)):
        return 1.0, 0.0
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (len(labels) - positive + 2))
    x, beta = np.column_stack([margins, np.ones(len(margins))]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ beta)
        slope = x.T @ (p - target) + 1e-3 * (beta - [1.0, 0.0])
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(curve, slope)
        beta = beta - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return max(0.1, float(beta[0])), float(beta[1])
