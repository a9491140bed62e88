"""Labelled rows for the scoring operators: which may be learnt from, and a bounded sample of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str, modulus: int = 5, remainder: int = 0) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo modulus, is remainder. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most rows labelled documents that aren't held out, chosen by a hash of the id.

    The ids chosen are broadcast: the limit bounds them. Of a document with
    several labels the greatest counts; null labels don't count.
    """
    known = labels.where(F.col(label).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("id", "text", "label")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if not len(x):
        return w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(x) + ridge * w * np.r_[np.ones(len(w) - 1), 1e-3]
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.diag(np.r_[np.ones(len(w) - 1), 1e-3]) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w
