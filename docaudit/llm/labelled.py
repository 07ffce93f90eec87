"""Labelled samples and small logistic models shared by the classifiers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, HELD_FOLD = 5, 0


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_FOLD, F.lit(False))


def label_sample(labels: DataFrame, label: str, sizes: Sequence[int]) -> DataFrame:
    """l_id, label: at most sizes[c] training documents of each class c, in the order of a hash of their ids.

    Null ids and labels are left out; an id labelled more than once takes its larger label.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("l_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("l_id"), "l_id").limit(n) for c, n in enumerate(sizes)]
    return parts[0].unionByName(parts[1])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, steps: int = 60, bias: bool = True) -> np.ndarray:
    """Ridge-regularised logistic regression by damped Newton steps; the bias (the last weight) is not penalised."""
    x = np.column_stack([x, np.ones(len(x))]) if bias else x
    weight = np.ones(len(x)) if weight is None else weight
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge * weight.sum() / max(1, len(x)) * 10)
    if bias:
        penalty[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (penalty * w * w).sum())

    now = loss(w)
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while (new := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        if now - new < 1e-9 * max(1.0, abs(now)):
            break
        w, now = w - size * step, new
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))
