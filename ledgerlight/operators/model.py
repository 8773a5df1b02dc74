"""Ridge regression from sums: one pass of aggregates, a small linear system on the driver."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from hashlib import sha256

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators.panel import FEATURES
from ledgerlight.operators.scoring import spearman

SCHEMA_VERSION = 1


@dataclass
class Model:
    """A fit with all that is needed to predict and to audit it."""

    trained_through: str
    train_dates: list[str]
    n_train_rows: int
    feature_names: list[str]
    coefficients: list[float]
    intercept: float
    feature_mean: list[float]
    feature_std: list[float]
    target_std: float
    alpha: float
    train_fingerprint: str
    schema_version: int = SCHEMA_VERSION
    in_sample_ic: float = 0.0
    notes: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Model:
        found = json.loads(text)
        if found.get("schema_version") != SCHEMA_VERSION:
            raise ValueError(f"the model has schema version {found.get('schema_version')}, not {SCHEMA_VERSION}")
        return Model(**found)

    def prediction(self) -> Column:
        """Predicted forward return in basis points, an expression over the features."""
        if list(self.feature_names) != FEATURES:
            raise ValueError(f"the model's features are {self.feature_names}, not {FEATURES}")
        z = [(F.col(c) - m) / (s if s > 0 else 1.0) * b for c, m, s, b in zip(self.feature_names, self.feature_mean, self.feature_std, self.coefficients, strict=True)]
        return (sum(z[1:], z[0]) + self.intercept) * self.target_std


def moments(panel: DataFrame, features: list[str] = FEATURES, target: str = "fwd_bps") -> DataFrame:
    """One row: n, and the sums, squares and products of features and target (s_i, p_i_j, t_i, sy, syy)."""
    x, y = [F.col(c) for c in features], F.col(target)
    k = range(len(x))
    return panel.agg(
        F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), *[F.sum(x[i]).alias(f"s_{i}") for i in k], *[F.sum(x[i] * y).alias(f"t_{i}") for i in k],
        *[F.sum(x[i] * x[j]).alias(f"p_{i}_{j}") for i in k for j in k if i <= j],
    )


def fingerprint(n: int, dates: list[str], symbols: list[str], mean: float, sd: float) -> str:
    """16 digits for a training set: its size, dates, symbols and the target's moments."""
    return sha256(f"{n}{'|'.join(dates)}{'|'.join(symbols)}{mean:.9f}:{sd:.9f}".encode()).hexdigest()[:16]


def fingerprint_row(panel: DataFrame) -> DataFrame:
    """One row (n, symbols, fingerprint): the same digits as ``fingerprint``, of a whole panel, as an expression."""
    got = panel.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("date")), "|").alias("dates"), F.array_join(F.array_sort(F.collect_set("symbol")), "|").alias("symbols"), F.avg("fwd_bps").alias("mean"), F.stddev_pop("fwd_bps").alias("sd"))
    text = F.concat(F.col("n").cast("string"), "dates", "symbols", F.format_string("%.9f:%.9f", "mean", "sd"))
    return got.select("n", "symbols", F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"))


def fit(panel: DataFrame, alpha: float = 50.0, features: list[str] = FEATURES) -> Model:
    """Both sides standardised; the intercept isn't penalised."""
    centre = panel.agg(*[F.avg(c).alias(c) for c in [*features, "fwd_bps"]]).first()
    if centre.fwd_bps is None:
        raise ValueError("there is no row to fit on")
    shifted = panel.withColumns({c: F.col(c) - centre[c] for c in [*features, "fwd_bps"]})
    got, k = moments(shifted, features).first(), range(len(features))
    n = got.n
    mean = np.array([got[f"s_{i}"] for i in k]) / n
    gram = np.array([[got[f"p_{min(i, j)}_{max(i, j)}"] for j in k] for i in k]) - n * np.outer(mean, mean)
    y_mean = got.sy / n
    y_sd = float(np.sqrt(max(0.0, got.syy / n - y_mean**2)))
    if y_sd <= 0:
        raise ValueError("the target doesn't vary")
    sd = np.sqrt(np.maximum(np.diag(gram) / n, 0))
    scale = np.where(sd > 0, sd, 1.0)
    cross = (np.array([got[f"t_{i}"] for i in k]) - n * mean * y_mean) / scale / y_sd
    beta = np.linalg.solve(gram / np.outer(scale, scale) + alpha * np.eye(len(features)), cross)
    mean, y_mean = mean + np.array([centre[c] for c in features]), y_mean + centre.fwd_bps
    names = {c: sorted(str(r[0]) for r in panel.select(c).distinct().collect()) if c in panel.columns else [] for c in ("date", "symbol")}
    model = Model(
        names["date"][-1] if names["date"] else "", names["date"], n, list(features), beta.tolist(), y_mean / y_sd, mean.tolist(), sd.tolist(), y_sd, float(alpha),
        fingerprint(n, names["date"], names["symbol"], y_mean, y_sd),
    )
    model.in_sample_ic = float(spearman(panel.withColumn("pred", model.prediction()), "pred", "fwd_bps").first().ic or 0.0)
    return model
