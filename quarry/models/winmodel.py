"""Win probabilities: a logistic model fitted by Newton steps, each one aggregate over all rows.

A step sums gradient and Hessian of the loss, d + d (d + 1) / 2 numbers for d features, in one pass with partial sums; only these
come to the driver, which solves a system of d unknowns. The fit stops when no weight moves by more than ``tol``.
Rows with a missing feature or label are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WinModel:
    """Weights by feature, the intercept first; how many steps were taken, and whether they ended by tolerance."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    steps: int
    converged: bool

    def probability(self) -> Column:
        return _sigmoid(self.features, self.weights)


def _sigmoid(features: Sequence[str], weights: Sequence[float]) -> Column:
    z = F.lit(float(weights[0]))
    for c, w in zip(features, weights[1:]):
        z = z + F.lit(float(w)) * F.col(c)
    return 1 / (1 + F.exp(-z))


def log_loss(p: Column, label: Column) -> Column:
    """Mean log loss; probabilities are kept off 0 and 1 by 1e-15."""
    p = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    return -F.avg(label * F.log(p) + (1 - label) * F.log(1 - p))


def fit(rows: DataFrame, features: Sequence[str], label: str, tol: float = 1e-9, most: int = 50, ridge: float = 0.0) -> WinModel:
    """The weights of least log loss, with ``ridge`` / 2 times the square of each but the intercept; rows is read once a step."""
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("_y")).dropna()
    xs = [F.lit(1.0), *[F.col(c) for c in features]]
    d = len(xs)
    weights = np.zeros(d)
    pull = np.array([0.0] + [ridge] * (d - 1))
    for step in range(1, most + 1):
        p = _sigmoid(features, weights)
        sums = [F.sum(x * (F.col("_y") - p)) for x in xs] + [F.sum(xs[i] * xs[j] * p * (1 - p)) for i in range(d) for j in range(i + 1)]
        got = rows.agg(*[s.alias(f"_{n}") for n, s in enumerate(sums)]).first()
        if got[0] is None:
            raise ValueError("there are no rows to fit")
        hessian = np.zeros((d, d))
        hessian[np.tril_indices(d)] = got[d:]
        hessian = hessian + np.tril(hessian, -1).T + np.diag(pull)
        # the least move where features depend on each other
        move = np.linalg.lstsq(hessian, np.array(got[:d]) - pull * weights, rcond=None)[0]
        weights = weights + move
        if np.abs(move).max() <= tol:
            return WinModel(tuple(features), tuple(weights), step, True)
    return WinModel(tuple(features), tuple(weights), most, False)


def calibration(rows: DataFrame, model: WinModel, label: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate): what the model says and what happened, by bins of probability."""
    held = rows.select(model.probability().alias("p"), F.col(label).cast("double").alias("y")).dropna()
    held = held.withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int"))
    return held.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))
