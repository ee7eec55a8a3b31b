"""Shared by the two classifiers: bounded labelled samples and logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.shared import materialize


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: dict[int, int]) -> DataFrame:
    """(doc_id, label, part, text), stored: for each label value at most ``most[value]`` labelled rows, chosen by a hash, with
    whole texts of any length; ``part`` deals them to 0..3 by another hash.

    Only the fit is bounded so: ids are chosen from ``labels`` first, so the join broadcasts at most sum(most) rows.
    Rows with a null label or text are not learnt from; a repeated id is learnt from once.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & keep)
    chosen = None
    for value, n in sorted(most.items()):
        part = rows.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", "text").where("text is not null")
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    return materialize(joined.select("doc_id", "label", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(4)).cast("int").alias("part"), "text"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50, times: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the intercept) by Newton steps, halved where they lead up; without two classes the intercept alone gives their share.
    A row stands for ``times`` equal ones, where given."""
    n = len(y)
    k = np.ones(n) if times is None else times
    width = x.shape[1] + 1
    if n == 0 or y.min() == y.max():
        w = np.zeros(width)
        w[-1] = np.log(((k * y).sum() + 1) / (k.sum() - (k * y).sum() + 1))
        return w
    a = np.column_stack([x, np.ones(n)])
    w, penalty = np.zeros(width), np.diag([ridge] * (width - 1) + [1e-9])

    def loss(v: np.ndarray) -> float:
        z = a @ v
        return float((k * np.logaddexp(0, z)).sum() - (k * y) @ z + v @ penalty @ v / 2)

    for _ in range(rounds):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (k * p * (1 - p))[:, None]).T @ a + penalty, a.T @ (k * (y - p)) - penalty @ w)
        while np.abs(step).max() >= 1e-8 and loss(w + step) > loss(w):
            step = step / 2
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
