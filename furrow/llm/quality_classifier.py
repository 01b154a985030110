"""Quality by Bradley-Terry pairwise ranking.

A document's strength is a linear function of its features.  Every pair of a
better and a worse labelled document gives a logistic loss on the difference of
their features; the scores' quantile at the share of worse documents is the threshold.
All labelled documents are learnt from.  The loss of all pairs is summed from
moments of bins of strengths, whose size does not depend on the number of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm import textcore as tc
from furrow.llm.storage import Scratch

FEATURES = ("log_words", "word_length", "symbols", "bars", "exclamations", "upper", "digits", "stops", "repeat_3", "repeat_1_next", "distinct", "line_words", "dup_lines")
#: The pairs of each document of the rarer label weigh as much as so many, against the penalty on the weights.
PAIRS_EACH = 16
#: Width of a bin of strengths, and terms of the Taylor series around the middles of two bins.
WIDTH, ORDERS = 0.125, 8
#: Newton steps at most, and the size of a step that ends them.
ROUNDS, DONE = 50, 1e-7
#: Parts into which a range of strengths is cut to find one by its rank.
CUTS = 4096
THRESHOLD = 0.7
#: How far apart scores are spread around the threshold.
SPREAD = 4.0


def _bytes(*marks: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(b"".join(marks))] = True
    return out


_MARKS = {"symbols": _bytes(b"#*$%&<>@^~_=+{}[]\\"), "bars": _bytes(b"|"), "exclamations": _bytes(b"!"), "upper": _bytes(bytes(range(65, 91))), "digits": _bytes(bytes(range(48, 58))), "stops": _bytes(b".,;:?")}


def measure(texts: pa.Array) -> np.ndarray:
    """One row of features for each text; a text without words has zeros."""
    w = tc.Words(texts)
    h, chars = w.hashes(), w.code_points()
    n, c = np.maximum(w.count, 1), np.maximum(w.per_doc(chars), 1)
    share = {}
    for name, marks in _MARKS.items():
        run = np.concatenate(([0], np.cumsum(marks[w.data])))
        share[name] = (run[w.off[1:]] - run[w.off[:-1]]) / c
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w.left[:-1] > 1)
    a, b, of = tc.lines(w)
    line = tc.mix(tc.span_hashes(w.data, a, b) + of.astype(np.uint64) * tc._LEN)
    n_lines = np.maximum(np.bincount(of, minlength=w.n_docs), 1)
    distinct_lines = np.bincount(of[np.unique(line, return_index=True)[1]], minlength=w.n_docs) if len(of) else np.zeros(w.n_docs)
    first = np.unique(h + w.doc.astype(np.uint64) * tc._LEN, return_index=True)[1]
    distinct = np.bincount(w.doc[first], minlength=w.n_docs) / n if len(h) else np.zeros(w.n_docs)
    out = [np.log1p(w.count), c / n, *share.values(), w.per_doc(w.repeated(w.grams(h, 3), 3)) / n, w.per_doc(again) / n, distinct, np.log1p(w.count / n_lines), 1 - distinct_lines / n_lines]
    return np.where((w.count > 0)[:, None], np.stack(out, axis=1), 0.0)


@dataclass
class Model:
    """Means and spreads of the features, weights of the strengths, and the threshold on them."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the strength at the cut scores ``THRESHOLD``."""
        z = SPREAD * (self.strength(x) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights


def _derivatives() -> list[np.polynomial.Polynomial]:
    """The logistic function and its derivatives, as polynomials of its own value."""
    x = np.polynomial.Polynomial([0.0, 1.0])
    out = [x]
    for _ in range(ORDERS - 1):
        out.append(out[-1].deriv() * (x - x * x))
    return out


_SIGMA = _derivatives()
_UPPER = np.triu_indices(len(FEATURES))


def _features(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy().reshape(-1, len(FEATURES))


def moments(rows: DataFrame, model: Model) -> dict[int, np.ndarray]:
    """Sums over the rows (label, x) of each label and bin of strengths, under 2 * bin + label.

    For each order, the power of a strength's distance from the bin's middle,
    alone and times each feature; then the products of two features.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = model.standard(_features(batch.column("x")))
            strength = z @ model.weights
            at = np.floor(strength / WIDTH)
            off = strength - (at + 0.5) * WIDTH
            one = np.hstack([np.ones((len(z), 1)), z])
            table = np.hstack([*(one * (off**k)[:, None] for k in range(ORDERS)), z[:, _UPPER[0]] * z[:, _UPPER[1]]])
            key = 2 * at.astype(np.int64) + batch.column("label").to_numpy()
            order = np.argsort(key, kind="stable")
            keys, first = np.unique(key[order], return_index=True)
            for k, total in zip(keys.tolist(), np.add.reduceat(table[order], first, axis=0), strict=True):
                held[k] = held[k] + total if k in held else total
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["key", "sums"])

    def add(key: tuple, parts: pa.Table) -> pa.Table:
        sums = parts.column("sums").combine_chunks()
        total = sums.flatten().to_numpy().reshape(len(sums), -1).sum(axis=0)
        return pa.table({"key": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([total], pa.list_(pa.float64()))})

    kinds = "key long, sums array<double>"
    parts = rows.select("label", "x").mapInArrow(run, kinds).groupBy("key").applyInArrow(add, kinds)
    return {r["key"]: np.array(r["sums"]) for r in parts.collect()}


def all_pairs(sums: dict[int, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss over every pair of a better and a worse document, its gradient, and roughly its second derivatives.

    A pair's loss depends on the difference of two strengths, so the Taylor series
    between the middles of two bins sums all their pairs from the bins' moments.
    """
    d = len(FEATURES)
    keys = {label: sorted(k for k in sums if k % 2 == label) for label in (0, 1)}
    middle = {label: (np.array(keys[label]) // 2 + 0.5) * WIDTH for label in keys}
    m = {label: np.stack([sums[k][: ORDERS * (d + 1)].reshape(ORDERS, d + 1) for k in keys[label]], axis=1) for label in keys}
    gap = middle[0][:, None] - middle[1]
    p = 1 / (1 + np.exp(-np.clip(gap, -500, 500)))
    value, gradient = 0.0, np.zeros(d)
    for n in range(ORDERS):
        slope = _SIGMA[n](p) / math.factorial(n)
        loss = _SIGMA[n - 1](p) / math.factorial(n) if n else np.logaddexp(0, gap)
        for j in range(n + 1):
            bad, good, times = m[0][n - j], m[1][j], math.comb(n, j) * (-1) ** j
            value += times * float(bad[:, 0] @ loss @ good[:, 0])
            gradient += times * (bad[:, 1:].T @ (slope @ good[:, 0]) - good[:, 1:].T @ (bad[:, 0] @ slope))
    # The second derivatives only steer the steps, so the middles of the bins do.
    bend = _SIGMA[1](p)
    upper = {label: np.stack([sums[k][ORDERS * (d + 1) :] for k in keys[label]]) for label in keys}
    own = np.zeros((d, d))
    own[_UPPER] = (bend @ m[1][0][:, 0]) @ upper[0] + (m[0][0][:, 0] @ bend) @ upper[1]
    cross = m[0][0][:, 1:].T @ bend @ m[1][0][:, 1:]
    return value, gradient, own + np.triu(own, 1).T - cross - cross.T


def at_rank(strengths: DataFrame, rank: int) -> float:
    """The mean of the strengths ``s`` at ``rank`` and before it, from 1 and in order, by counts of ever smaller ranges."""
    low, high, before = *strengths.agg(F.min("s"), F.max("s")).first(), 0
    while low < high:
        step = (high - low) / CUTS
        part = F.least(F.floor((F.col("s") - low) / step), F.lit(CUTS - 1)) if step > 0 else F.when(F.col("s") > low, 1).otherwise(0)
        counts = strengths.filter(F.col("s").between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect()
        for r in sorted(counts, key=lambda r: r["part"]):
            if before + r["n"] >= rank:
                break
            before += r["n"]
        low, high = r["low"], r["high"]
    upto, after = strengths.agg(F.count_if(F.col("s") <= low), F.min(F.when(F.col("s") > low, F.col("s")))).first()
    return low if upto > rank or after is None else (low + after) / 2


def fit(rows: DataFrame, penalty: float = 1.0) -> Model:
    """Fits strengths to all pairs of the rows (label, x), label 1 for better and 0.

    Without both labels every text scores the same, above the cut if all are
    better.  The rows are read once for each Newton step.
    """
    rows = rows.filter(F.col("label").isin(0, 1))
    columns = [F.col("x")[i] for i in range(len(FEATURES))]
    few, n, *found = rows.agg(F.count_if(F.col("label") == 0), F.count("*"), *map(F.avg, columns), *map(F.stddev_pop, columns)).first()
    mean, spread = (np.array(found, float).reshape(2, -1) if n else np.zeros((2, len(FEATURES)))).round(12)
    model = Model(mean, spread + 1e-6, np.zeros(len(FEATURES)), 0.0)
    if not 0 < few < n:
        model.cut = 1.0 if few else 0.0
        return model
    scale = PAIRS_EACH / max(few, n - few)
    w = step = model.weights
    best = None
    for _ in range(ROUNDS):
        model.weights = w - step
        value, gradient, bend = all_pairs(moments(rows, model))
        value = scale * value + penalty / 2 * float(model.weights @ model.weights)
        if best is not None and value > best * (1 + 1e-12) and np.abs(step).max() > DONE:
            step = step / 2
            continue
        best, w = value, model.weights
        step = np.linalg.solve(scale * bend + penalty * np.eye(len(w)), scale * gradient + penalty * w)
        if np.abs(step).max() < DONE:
            break
    # Sums come in any order; what is rounded here agrees between reruns.
    model.weights = w.round(6)
    scratch = Scratch(rows.sparkSession, "strengths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.strength(_features(batch.column("x"))))], names=["s"])

    strengths = scratch.keep(rows.select("x").mapInArrow(run, "s double"), "strengths")
    model.cut = at_rank(strengths, min(few, n - 1))
    scratch.drop(strengths)
    return model


def measured(docs: DataFrame, keep: str) -> DataFrame:
    given = docs.select(keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tc.row_chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(measure(part.column("text"))), pa.list_(pa.float64()))], names=[keep, "x"])

    return given.mapInArrow(run, f"{keep} {given.schema[keep].dataType.simpleString()}, x array<double>")


def fit_sample(sample: DataFrame) -> Model:
    """Learns from all rows (doc_id, label, text)."""
    scratch = Scratch(sample.sparkSession, "quality")
    rows = scratch.keep(measured(sample, "label"), "labelled")
    model = fit(rows)
    scratch.drop(rows)
    return model


def fit_labelled(features: DataFrame, chosen: DataFrame) -> Model:
    """Learns from all rows (doc_id, x) with a label in the rows (doc_id, label); of rows that share an id, the smallest features stand for all."""
    scratch = Scratch(features.sparkSession, "quality")
    rows = scratch.keep(features.join(chosen.hint("merge"), "doc_id").groupBy("doc_id", "label").agg(F.min("x").alias("x")), "labelled")
    model = fit(rows)
    scratch.drop(rows)
    return model


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score, predicted) of every document.

    A null or empty text has features of zero and is scored like any other.
    Repeated rows give repeated rows; other columns are left out.
    """
    return score(measured(docs, "doc_id"), model)


def score(features: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score, predicted) of the rows (doc_id, x)."""
    kind = features.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_features(batch.column("x"))))], names=["doc_id", "score"])

    scored = features.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
