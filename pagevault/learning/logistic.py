"""Logistic regression by Newton's method, whose gradient and second derivatives are sums over all rows.

Each round is one aggregate of built-in functions: tasks add up the loss, the gradient and the upper half of the second derivatives, and
the tasks' sums are merged; no row, sample or vector reaches Python. The driver solves one small system and halves a step that
made the loss larger. Probabilities are one expression, so that predicting stays narrow.

Scale: a round reads the features' columns only and shuffles one row a task of (d + 1)(d + 4) / 2 + 2 numbers for d features.

Defined results: rows with a null or non-finite feature, or a label that is neither 0 nor 1, take no part in fitting and get a null
probability; without rows all coefficients are 0; classes that features tell apart have no finite coefficients without l2, and fitting then
raises after `rounds`; features that depend on each other need l2 > 0, and else get the solution of least length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Logistic:
    features: tuple[str, ...]
    intercept: float
    weights: tuple[float, ...]
    rounds: int

    def margin(self) -> Column:
        return _margin(self.features, np.array([self.intercept, *self.weights]))

    def probability(self) -> Column:
        return F.when(_usable(self.features), 1 / (1 + F.exp(-self.margin())))


def _double(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def _margin(features: tuple[str, ...], w: np.ndarray) -> Column:
    return sum((F.lit(float(c)) * _double(f) for c, f in zip(w[1:], features, strict=True)), F.lit(float(w[0])))


def _usable(features: tuple[str, ...]) -> Column:
    good = F.lit(True)
    for f in features:
        good = good & F.coalesce(F.abs(_double(f)) < float("inf"), F.lit(False))
    return good


def sums(rows: DataFrame, features: tuple[str, ...], w: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
    """The number of rows, their loss, its gradient and its second derivatives at w. rows: the features and the label y."""
    m = _margin(features, w)
    p = 1 / (1 + F.exp(-m))
    x = [F.lit(1.0), *map(_double, features)]
    loss = F.greatest(m, F.lit(0.0)) - m * F.col("y") + F.log1p(F.exp(-F.abs(m)))
    told = rows.select(loss.alias("loss"), (p - F.col("y")).alias("g"), (p * (1 - p)).alias("h"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    every = [F.count("*"), F.sum("loss"), *[F.sum(F.col("g") * F.col(f"x{i}")) for i in range(len(x))], *[F.sum(F.col("h") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]]
    n, total, *rest = told.agg(*[c.alias(f"s{i}") for i, c in enumerate(every)]).first()
    rest = np.array([v or 0.0 for v in rest])
    second = np.zeros((len(x), len(x)))
    for (i, j), v in zip(pairs, rest[len(x) :], strict=True):
        second[i, j] = second[j, i] = v
    return n, total or 0.0, rest[: len(x)], second


def fit(df: DataFrame, features: list[str], label: str, *, l2: float = 0.0, rounds: int = 50, near: float = 1e-10) -> Logistic:
    """l2 weighs half the squared length of the weights (not of the intercept) against the sum of the losses."""
    names = tuple(features)
    rows = df.where(F.col(label).isin(0, 1) & _usable(names)).select(*[_double(f).alias(f) for f in names], F.col(label).cast("double").alias("y"))
    w, penalty = np.zeros(len(names) + 1), np.array([0.0, *[l2] * len(names)])

    def at(w: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
        n, loss, first, second = sums(rows, names, w)
        return n, loss + penalty @ (w * w) / 2, first + penalty * w, second + np.diag(penalty)

    n, loss, first, second = at(w)
    if not n:
        return Logistic(names, 0.0, (0.0,) * len(names), 0)
    for done in range(1, rounds + 1):
        step = np.linalg.lstsq(second, first, rcond=1e-13)[0]
        new = w - step
        _, new_loss, first, second = at(new)
        while new_loss > loss + 1e-9 * abs(loss) and np.abs(step).max() > near:
            step = step / 2
            new = w - step
            _, new_loss, first, second = at(new)
        w, loss = new, new_loss
        if np.abs(step).max() <= near * max(1.0, np.abs(w).max()):
            return Logistic(names, float(w[0]), tuple(map(float, w[1:])), done)
    raise RuntimeError(f"no finite coefficients within {rounds} rounds: the features may tell the classes apart; set l2")
