"""Small linear models, fitted on bounded samples on the driver, or by sums over a table of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Sums of more partitions than PARTS are added up in MERGED tasks before they are sent to the driver.
PARTS, MERGED = 64, 16


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; ``y`` may be soft."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        slope = x.T @ (weight * (p - y)) + ridge * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Squared-hinge support vector machine by Newton steps; ``y`` is -1 or 1, the last column of ``x`` the constant."""
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-3 * ridge
    for _ in range(rounds):
        gap = 1 - y * (x @ beta)
        inside = gap > 0
        xi, wi = x[inside], weight[inside]
        slope = penalty @ beta - xi.T @ (wi * y[inside] * gap[inside])
        step = np.linalg.solve(penalty + (xi * wi[:, None]).T @ xi, slope)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def summed(table: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum of ``f`` over the batches of the table; only sums reach the driver. None of an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [f(batch) for batch in batches if batch.num_rows]
        if found:
            yield pa.record_batch([pa.array([sum(found).tobytes()], pa.binary())], ["sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.frombuffer(v.as_py()) for batch in batches for v in batch.column(0)]
        if found:
            yield pa.record_batch([pa.array([sum(found).tobytes()], pa.binary())], ["sums"])

    sums = table.mapInArrow(run, "sums binary")
    if table.rdd.getNumPartitions() > PARTS:
        sums = sums.repartition(MERGED).mapInArrow(merge, "sums binary")
    found = [np.frombuffer(r["sums"]) for r in sums.collect()]
    return sum(found) if found else None


def fit_logistic_over(table: DataFrame, rows_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]], width: int, ridge: float = 1.0, rounds: int = 20) -> np.ndarray:
    """As ``fit_logistic``, for the (x, y, weight) that ``rows_of`` makes of the batches of a table."""
    beta = np.zeros(width)
    for _ in range(rounds):
        now = beta

        def newton(batch: pa.RecordBatch, now: np.ndarray = now) -> np.ndarray:
            x, y, weight = rows_of(batch)
            p = sigmoid(x @ now)
            return np.concatenate([x.T @ (weight * (p - y)), ((x * (weight * p * (1 - p))[:, None]).T @ x).ravel()])

        sums = summed(table, newton)
        if sums is None:
            break
        step = np.linalg.solve(sums[width:].reshape(width, width) + ridge * np.eye(width), sums[:width] + ridge * beta)
        beta = beta - step
        if np.abs(step).max() < 1e-6:
            break
    return beta
