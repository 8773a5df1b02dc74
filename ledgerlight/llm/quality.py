"""A quality classifier: Naive Bayes support vectors.

Every n-gram indicator is scaled by its log-count ratio between the classes; dual coordinate descent then
fits a linear hinge-loss model, both classes weighing alike. A fifth of the rows is kept apart to turn
margins into probabilities by a logistic curve. The fit takes at most ``max_rows`` labelled rows, a bounded
sample by a hash of doc_id; scoring takes all documents, whole, in one pass without a shuffle.

Defined cases: a null or empty text has no feature and gets the score of the bias; without labels of both classes
every score is the smoothed share of label 1 (0.5 without any); repeated rows are scored alike; an empty table
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.features import Linear, blocks
from ledgerlight.llm.learning import MAX_ROWS, held_out, training, vocabulary

THRESHOLD = 0.7


@dataclass
class Classifier:
    linear: Linear
    slope: float
    offset: float

    def scores(self, texts: list[str | None], wanted: np.ndarray) -> np.ndarray:
        z = self.slope * self.linear.margins(texts, wanted) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_count_ratios(x: list[np.ndarray], y: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    counts = [smooth + np.bincount(np.concatenate([row for row, label in zip(x, y, strict=True) if label == k]), minlength=size) for k in (1, 0)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def coordinate_descent(x: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float, epochs: int, seed: int = 1) -> np.ndarray:
    """Weights of the scaled indicators and, last, of a constant: the dual of the hinge loss, a row at a time."""
    sign, bias = np.where(y == 1, 1.0, -1.0), len(ratio)
    cost = c * len(y) / (2 * np.where(y == 1, (y == 1).sum(), (y != 1).sum()))
    rows = [np.append(row, bias) for row in x]
    values = [np.append(ratio[row], 1.0) for row in x]
    norms = np.array([v @ v for v in values])
    w, alpha, rng = np.zeros(bias + 1), np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            slack = sign[i] * (w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - slack / norms[i], 0.0), cost[i])
            step, alpha[i] = new - alpha[i], new
            if step:
                w[rows[i]] += step * sign[i] * values[i]
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make margins probabilities: Newton steps on smoothed labels."""
    up, down = (y == 1).sum(), (y != 1).sum()
    goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    scale = max(1e-9, np.abs(margin).mean()) if len(margin) else 1.0
    x, b = np.stack([margin / scale, np.ones(len(margin))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (goal - p) - 1e-4 * b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0] / scale), float(b[1])


def fit(y: np.ndarray, x: list[np.ndarray], least: int = 5, c: float = 0.02, epochs: int = 30) -> Classifier:
    """y: 0 or 1. x: each row's features."""
    features, rows = vocabulary(x, least)
    share = (np.sum(y == 1) + 1) / (len(y) + 2)
    if not len(features) or len(set(y.tolist())) < 2:
        return Classifier(Linear(np.zeros(0, np.uint32), np.zeros(0), 0.0), 0.0, float(np.log(share / (1 - share))))
    apart = np.zeros(len(y), bool)
    for k in (0, 1):
        apart[np.flatnonzero(y == k)[::5]] = (y == k).sum() >= 10
    part = [row for row, out in zip(rows, apart, strict=True) if not out]
    ratio = log_count_ratios(part, y[~apart], len(features))
    w = coordinate_descent(part, y[~apart], ratio, c, epochs)
    weights = w[:-1] * ratio
    check = apart if apart.any() else ~apart
    margin = np.array([weights[row].sum() + w[-1] for row, seen in zip(rows, check, strict=True) if seen])
    return Classifier(Linear(features, weights, float(w[-1])), *logistic_curve(margin, y[check]))


def scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Put ``model.scores`` in place of the text, the last column."""
    wanted = model.linear.wanted
    for batch in batches:
        out = np.zeros(batch.num_rows)
        for first, texts in blocks(batch.column(batch.num_columns - 1)):
            out[first : first + len(texts)] = model.scores(texts, wanted)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*batch.schema.names[:-1], "score"])


def trained(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Classifier:
    y, x = training(docs, labels, "quality", max_rows)
    used = np.flatnonzero((y == 0) | (y == 1))
    return fit(y[used], [x[i] for i in used])


def quality_scores(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scores = docs.select("doc_id", "text").mapInArrow(partial(scored, model=model), "doc_id long, score double")
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filtered(batches: Iterator[pa.RecordBatch], model, at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    wanted = model.linear.wanted
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for first, texts in blocks(batch.column(at)):
            keep[first : first + len(texts)] = model.scores(texts, wanted) >= threshold
        yield batch.filter(pa.array(keep))


def accepted(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``; same columns."""
    return docs.mapInArrow(partial(filtered, model=model, at=docs.columns.index("text"), threshold=threshold), docs.schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Score all documents for quality, as labels.quality marks it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_scores(docs, trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
