"""Bounded labelled samples and logistic regression on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled training rows that a classifier is fitted on, at most; taken in the order of a hash of their ids.
MAX_SAMPLE = 20_000


def chosen_labels(labels: DataFrame, label: str, train: Column) -> DataFrame:
    """Rows (doc_id, label) of the labelled training documents; the larger of two labels counts, null ones and null ids do not."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).filter(train)
    return known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, limit: int = MAX_SAMPLE) -> DataFrame:
    """Rows (doc_id, label, text) of at most ``limit`` labelled training documents.

    The sample's ids are few enough to send to every reader of the documents.
    A document labelled twice has the larger label; null labels and ids count
    for nothing; of documents that share an id, the smallest text stands for all.
    """
    chosen = chosen_labels(labels, label, train).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, prior: np.ndarray | None = None, rounds: int = 50) -> np.ndarray:
    """Weights that minimise logistic loss plus a squared distance from the prior, by damped Newton steps."""
    prior = np.zeros(x.shape[1]) if prior is None else prior
    w = prior.copy()

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, -(2 * y - 1) * (x @ v)).sum() + penalty / 2 * ((v - prior) ** 2).sum())

    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (p - y) + penalty * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), gradient)
        scale = 1.0
        while loss(w - scale * step) > loss(w) and scale > 1e-4:
            scale /= 2
        w = w - scale * step
        if np.abs(step).max() < 1e-8:
            break
    return w
