"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity grades 0 < 1 < ... share one weight vector; ordered thresholds part them: P(grade <= k) =
logistic(threshold k - margin). The fit is the optimum of the penalised likelihood, by Newton steps, on a bounded
sample of labelled rows. Scoring takes all documents, whole, in one pass without a shuffle, and gives the
expected severity.

The labels are the grades, as many as they have; each but the lowest has a threshold. Labels that only mark toxic documents (0 or 1) make
two grades and one threshold, and the expected severity is then the chance of being toxic: nothing in such labels tells how severe a
document is, so no further grade is made up.

The fit keeps the features that part toxic from other rows most surely, by the log odds ratio over its standard error; the others have no
weight. How many is a parameter, ``kept``, or else chosen from ``CHOICES``: each in turn is fitted without a fifth of the rows of each grade,
features picked anew, and the one under which the left-out rows are likeliest is taken. Rows that are held out have no part in it.

Defined cases: a null or empty text has the severity of no feature; a long text counts whole, each feature once; features that tie at the last
place kept are taken in the order of their hashes; a grade that no row has gets no chance; where a grade has fewer than five rows the most
features are kept; without labels of two grades the severity of all is the mean grade seen (0 without any); repeated rows are scored alike; an
empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.features import Linear
from ledgerlight.llm.learning import MAX_ROWS, held_out, training, vocabulary
from ledgerlight.llm.quality import scored

#: Numbers of features with a weight to choose from, and the parts of the labelled rows that judge them.
CHOICES, PARTS = (250, 500, 1000, 2000, 4000), 5
#: Of being toxic at all; below a half, as a missed document costs more than a second look.
THRESHOLD = 0.3


@dataclass
class Ordinal:
    linear: Linear
    thresholds: list[float]

    def scores(self, texts: list[str | None], wanted: np.ndarray) -> np.ndarray:
        return self.linear.margins(texts, wanted)


def sureness(rows: list[np.ndarray], marked: np.ndarray, size: int) -> np.ndarray:
    """Of each feature, the log odds ratio between marked and other rows over its standard error."""
    counts = [np.bincount(np.concatenate([r for r, m in zip(rows, marked, strict=True) if m == k] or [np.zeros(0, np.int64)]), minlength=size) + 0.5 for k in (True, False)]
    totals = marked.sum() + 1, (~marked).sum() + 1
    ratio = np.log(counts[0] / (totals[0] - counts[0] + 0.5)) - np.log(counts[1] / (totals[1] - counts[1] + 0.5))
    return ratio / np.sqrt(sum(1 / c for c in counts))


def logistic(z: np.ndarray) -> np.ndarray:
    small = np.exp(-np.abs(z))
    return np.where(z >= 0, 1, small) / (1 + small)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


class Graded:
    """Rows of grades 0, 1, ... and their features; minus the log likelihood of weights followed by thresholds, convex in both together.

    A row of grade k lies under threshold k and over threshold k - 1. With ``a`` and ``b`` its distances to the two and ``gap`` between them,
    -log P = softplus(-a) + softplus(b) - log(1 - exp(-gap)). The first grade has no ``b``, the last no ``a``, and neither has a gap.
    """

    def __init__(self, y: np.ndarray, rows: list[np.ndarray], size: int, cuts: int) -> None:
        self.n, self.size, self.cuts = len(y), size, cuts
        self.row, self.column = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
        self.under, self.over = np.minimum(y, cuts - 1), np.maximum(y - 1, 0)
        self.has_under, self.has_over = y < cuts, y > 0
        self.between = np.bincount(y, minlength=cuts + 1)[1:cuts]

    def distances(self, params: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        margin, cut = np.bincount(self.row, params[self.column], self.n), params[self.size :]
        return (cut[self.under] - margin) * self.has_under, (cut[self.over] - margin) * self.has_over, np.diff(cut)

    def gathered(self, a: np.ndarray, b: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """The transpose of ``distances``."""
        cut = np.bincount(self.under, a * self.has_under, self.cuts) + np.bincount(self.over, b * self.has_over, self.cuts)
        cut[1:] += gap
        cut[:-1] -= gap
        return np.concatenate((-np.bincount(self.column, (a * self.has_under + b * self.has_over)[self.row], self.size), cut))

    def loss(self, params: np.ndarray) -> float:
        a, b, gap = self.distances(params)
        if (gap <= 0).any():
            return np.inf
        return softplus(-a[self.has_under]).sum() + softplus(b[self.has_over]).sum() - (self.between * np.log(-np.expm1(-gap))).sum()


def optimum(data: Graded, penalty: float, tolerance: float = 1e-7, rounds: int = 200) -> np.ndarray:
    """Weights and thresholds of the least loss plus half the penalty times the squared weights: Newton steps by conjugate gradients, halved until they descend."""
    share = np.array([(data.has_over & (data.over >= k)).mean() for k in range(data.cuts)])
    cut = np.log(1 / share - 1)
    cut = cut[0] + np.concatenate((np.zeros(1), np.cumsum(np.maximum(np.diff(cut), 0.1))))
    params, ridge = np.concatenate((np.zeros(data.size), cut)), np.concatenate((np.full(data.size, penalty), np.zeros(data.cuts)))
    total = lambda at: data.loss(at) + (ridge * at * at).sum() / 2
    now = total(params)
    for _ in range(rounds):
        a, b, gap = data.distances(params)
        bend = logistic(a) * logistic(-a), logistic(b) * logistic(-b), data.between * np.exp(-gap) / np.expm1(-gap) ** 2
        left = -data.gathered(-logistic(-a), logistic(b), -data.between / np.expm1(gap)) - ridge * params
        largest = np.abs(left).max()
        if largest < tolerance:
            return params
        curve = ridge + np.abs(data.gathered(bend[0], bend[1], 0 * gap))
        curve[data.size + 1 :] += bend[2]
        curve[data.size : -1] += bend[2]
        slope, step, goal = left, np.zeros_like(params), min(0.1, largest**0.5) * np.linalg.norm(left)
        towards = left / curve
        way, size = towards, left @ towards
        for _ in range(1000):
            bent = data.gathered(*(c * d for c, d in zip(bend, data.distances(way), strict=True))) + ridge * way
            far = size / (way @ bent)
            step, left = step + far * way, left - far * bent
            if np.linalg.norm(left) < goal:
                break
            towards = left / curve
            size, before = left @ towards, size
            way = towards + size / before * way
        part = 1.0
        while (new := total(params + part * step)) > now - 1e-4 * part * (slope @ step) + 1e-12 * abs(now) and part > 1e-9:
            part /= 2
        params, now = params + part * step, new
    raise RuntimeError(f"no optimum after {rounds} steps: a slope of {largest} is left")


def fewer(rows: list[np.ndarray], y: np.ndarray, size: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the ``most`` surest features, and for each feature its place among them or -1."""
    kept = np.sort(np.argsort(-np.abs(sureness(rows, y > 0, size)), kind="stable")[:most])
    place = np.full(size, -1)
    place[kept] = np.arange(len(kept))
    return kept, place


def renamed(rows: list[np.ndarray], place: np.ndarray) -> list[np.ndarray]:
    return [place[r][place[r] >= 0] for r in rows]


def chosen(y: np.ndarray, rows: list[np.ndarray], size: int, cuts: int, penalty: float) -> int:
    """The number of features in ``CHOICES`` under which parts left out are likeliest; the least of equals."""
    part = np.zeros(len(y), np.int64)
    for k in range(cuts + 1):
        part[y == k] = np.arange((y == k).sum()) % PARTS
    if min(np.bincount(y)) < PARTS:
        return CHOICES[-1]
    loss = dict.fromkeys(CHOICES, 0.0)
    for out in range(PARTS):
        fitted, judged = np.flatnonzero(part != out), np.flatnonzero(part == out)
        for most in CHOICES:
            kept, place = fewer([rows[i] for i in fitted], y[fitted], size, most)
            inside = [Graded(y[some], renamed([rows[i] for i in some], place), len(kept), cuts) for some in (fitted, judged)]
            loss[most] += inside[1].loss(optimum(inside[0], penalty, 1e-3))
    return min(CHOICES, key=loss.__getitem__)


def fit(y: np.ndarray, x: list[np.ndarray], least: int = 5, penalty: float = 0.3, most: int | None = None) -> Ordinal:
    """y: grades from 0. x: each row's features. most: features with a weight; None: as many as suit parts left out."""
    features, rows = vocabulary(x, least)
    grades, levels = int(y.max(initial=0)), np.unique(y)
    if len(levels) < 2 or not len(features):
        mean = float(y.mean()) if len(y) else 0.0
        share = min(max(mean / max(1, grades), 1e-6), 1 - 1e-6)
        return Ordinal(Linear(np.zeros(0, np.uint32), np.zeros(0), 0.0), [-float(np.log(share / (1 - share)))] * max(1, grades))
    seen, cuts = np.searchsorted(levels, y), len(levels) - 1
    kept, place = fewer(rows, seen, len(features), most or chosen(seen, rows, len(features), cuts, penalty))
    params = optimum(Graded(seen, renamed(rows, place), len(kept), cuts), penalty)
    thresholds = [float(params[len(kept) + k - 1]) if k else float(min(0.0, params[len(kept)])) - 60.0 for k in np.searchsorted(levels, np.arange(grades), "right")]
    return Ordinal(Linear(features[kept], params[: len(kept)], 0.0, heads=True), thresholds)


def above(model: Ordinal) -> list[Column]:
    """P(grade > k) for each threshold, from the margin in ``score``."""
    return [1 / (1 + F.exp(F.lit(t) - F.col("score"))) for t in model.thresholds]


def trained(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, label: str = "toxic", kept: int | None = None) -> Ordinal:
    """A model of the grades in a column of ``labels``; negative ones are passed over."""
    y, x = training(docs, labels, label, max_rows, heads=True)
    used = np.flatnonzero(y >= 0)
    return fit(y[used], [x[i] for i in used], most=kept)


def severities(docs: DataFrame, model: Ordinal, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, severity (expected grade), p_toxic, grade (the last that is reached with a chance of ``threshold`` or more), toxic (0 or 1)."""
    margins = docs.select("doc_id", "text").mapInArrow(partial(scored, model=model), "doc_id long, score double")
    chances = above(model)
    grade = sum((c >= threshold).cast("int") for c in chances[1:]) + (chances[0] >= threshold).cast("int")
    severity = sum(chances[1:], chances[0])
    return margins.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), severity.alias("severity"), chances[0].alias("p_toxic"), grade.alias("grade"), (chances[0] >= threshold).cast("int").alias("toxic"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Severity of all documents, learnt from labels.toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return severities(docs, trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
