"""Linear models from one table of sums.

A ridge fit on any subset of columns needs only the sums of products of all
columns and the target. One aggregation collects them; every feature count,
every refit and every step of a descent is then arithmetic on a small matrix.

A row contributes the pairs of its non-zero entries, so one-hot columns cost
what they hold: a row with eight numbers and two levels gives 78 products, not
one for every pair of levels. Partial aggregation leaves at most one row a pair
and task. A missing value counts as 0, the training minimum after scaling.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Sums of products of (1, columns..., target)."""

    columns: list[str]
    sums: np.ndarray

    @property
    def n(self) -> float:
        return float(self.sums[0, 0])

    def centred(self, features: list[str]) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, float]:
        """(X'X, X'y, y'y) around the means, and the means of X and y."""
        at = [self.columns.index(f) + 1 for f in features]
        y = len(self.columns) + 1
        mean = self.sums[0] / self.n
        around = self.sums - self.n * np.outer(mean, mean)
        return around[np.ix_(at, at)], around[at, y], float(around[y, y]), mean[at], float(mean[y])


@dataclass
class LinearFit:
    features: list[str]
    weights: list[float]
    intercept: float

    def expression(self, values: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for name, weight in zip(self.features, self.weights):
            total = total + F.lit(weight) * values[name]
        return total


def moments(df: DataFrame, values: dict[str, Column], target: Column) -> Moments:
    """Sums of products over all rows of ``df``; one row a pair of columns reaches the driver."""
    columns = list(values)
    size = len(columns) + 2
    entries = [F.lit(1.0), *(F.coalesce(v.cast("double"), F.lit(0.0)) for v in values.values()), target.cast("double")]
    row = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(entries)]), lambda e: e["v"] != 0)
    rows = df.where(target.isNotNull()).select(row.alias("z"))

    def pairs(a):
        return F.transform(F.filter("z", lambda b: b["i"] >= a["i"]),
                           lambda b: F.struct(a["i"].alias("i"), b["i"].alias("j"), (a["v"] * b["v"]).alias("v")))

    found = rows.select(F.inline(F.flatten(F.transform("z", pairs)))).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((size, size))
    for r in found:
        sums[r["i"], r["j"]] = sums[r["j"], r["i"]] = r["v"]
    return Moments(columns, sums)


def ridge(m: Moments, features: list[str], alpha: float = 1.0) -> LinearFit:
    """Least squares with an L2 penalty on the weights; the intercept is free."""
    if not m.n:
        raise ValueError("no training rows")
    xx, xy, _, mx, my = m.centred(features)
    weights = np.linalg.solve(xx + alpha * np.eye(len(features)), xy)
    return LinearFit(list(features), weights.tolist(), float(my - weights @ mx))


def descent(m: Moments, features: list[str], steps: int, alpha: float = 1.0) -> list[tuple[float, float]]:
    """(objective, seconds since the start) before each of ``steps`` gradient steps and after the last one.

    The objective is half the mean squared error plus the penalty over the row
    count. The step is one over the trace of its Hessian, which is at least
    its largest eigenvalue, so the objective never rises.
    """
    if not m.n:
        raise ValueError("no training rows")
    xx, xy, yy, _, _ = m.centred(features)
    hessian, slope = (xx + alpha * np.eye(len(features))) / m.n, xy / m.n
    step = 1.0 / np.trace(hessian)
    w, losses, t0 = np.zeros(len(features)), [], time.perf_counter()
    for _ in range(steps + 1):
        losses.append((float(yy / m.n / 2 - slope @ w + w @ hessian @ w / 2), time.perf_counter() - t0))
        w = w + step * (slope - hessian @ w)
    return losses
