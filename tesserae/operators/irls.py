"""Poisson regressions by iteratively reweighted least squares, many at a time.

Each iteration is one scan for all models: a task adds up, for each model, the Gram matrix of its columns and what stands on
its right side; sums of sums meet in an aggregate, and the driver solves systems as large as a model has columns. Models may
differ in columns, ridge, link and the months that they learn from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scans at most, and the largest change of a coefficient at which a model has settled.
ROUNDS, TOLERANCE = 50, 1e-9
#: The bounds of a log rate.
LOW, HIGH = -4.0, 4.0


@dataclass
class Problem:
    """Columns by their place in the matrix; rows with t < before only, where that is set."""

    cols: list[int]
    reg: float = 0.0
    link: str = "log"
    before: int | None = None
    mean: np.ndarray = field(default=None)
    std: np.ndarray = field(default=None)
    beta: np.ndarray = field(default=None)  # of scaled columns; the intercept is the last
    covariance: np.ndarray = field(default=None)  # of beta
    settled: bool = False

    def plain(self) -> np.ndarray:
        """Coefficients of the columns as they are, the intercept last."""
        own = self.beta[:-1] / self.std
        return np.append(own, self.beta[-1] - own @ self.mean)


def matrix(df: DataFrame, cols: list[str], y: str = "n", t: Column | None = None, offset: Column | None = None, *keep: str) -> DataFrame:
    """x (array), y, t, offset of each row, for the functions below; the caller persists it."""
    double = lambda c: F.col(c).cast("double")
    return df.select(F.array(*map(double, cols)).alias("x"), double(y).alias("y"), (F.lit(0) if t is None else t).cast("long").alias("t"), (F.lit(0.0) if offset is None else offset).cast("double").alias("offset"), *keep)


def month_number(month: str = "month") -> Column:
    return F.year(month) * 12 + F.month(month)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    x = batch.column("x")
    flat = np.asarray(x.flatten())
    return flat.reshape(batch.num_rows, -1), *(batch.column(c).to_numpy() for c in ("y", "t", "offset"))


def _summed(rows: DataFrame, one, n: int) -> dict[int, np.ndarray]:
    """Sums over all rows of what one(x, y, t, offset) yields for each model: (model, vector). n models; vectors are as long as a
    model's matrix, so what the driver gets grows with the models alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                for k, v in one(*_arrays(b)):
                    total[k] = total[k] + v if k in total else v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(map(np.ascontiguousarray, total.values())), pa.list_(pa.float64()))], names=["k", "v"])

    parts = rows.select("x", "y", "t", "offset").mapInArrow(run, "k int, v array<double>").select("k", F.posexplode("v").alias("i", "v"))
    out = parts.groupBy("k", "i").agg(F.sum("v").alias("v")).toArrow()
    k, i, v = (out.column(c).to_numpy() for c in ("k", "i", "v"))
    return {m: v[k == m][np.argsort(i[k == m])] for m in range(n) if np.any(k == m)}


def scale(rows: DataFrame, problems: list[Problem]) -> None:
    """Means and population standard deviations (0 becomes 1) of each problem's rows, about the first row's values."""
    first = rows.select("x").first()
    if first is None:
        raise ValueError("no rows to learn from")
    centre = np.array(first["x"])
    cuts = sorted({p.before for p in problems}, key=lambda c: (c is not None, c))

    def one(x, y, t, offset):
        for k, cut in enumerate(cuts):
            own = (x if cut is None else x[t < cut]) - centre
            yield k, np.concatenate(([len(own)], own.sum(axis=0), (own * own).sum(axis=0)))

    sums = _summed(rows, one, len(cuts))
    for p in problems:
        n, rest = sums[cuts.index(p.before)][0], sums[cuts.index(p.before)][1:].reshape(2, -1)
        if not n:
            raise ValueError("a model has no rows to learn from")
        mean = rest[0] / n
        std = np.sqrt(np.maximum(rest[1] / n - mean * mean, 0))
        std[std < 1e-12 * (1 + np.abs(mean + centre))] = 0
        p.mean, p.std = (mean + centre)[p.cols], np.where(std == 0, 1.0, std)[p.cols]


def rate_and_slope(eta: np.ndarray, link: str) -> tuple[np.ndarray, np.ndarray]:
    """The rate and how it changes with the linear predictor."""
    if link == "log":
        rate = np.exp(np.clip(eta, -30, 30))
        return rate, rate
    if link == "sqrt":
        return np.maximum(eta * eta, 1e-10), np.where(np.abs(eta) < 1e-5, 1e-5, 2 * eta)
    raise ValueError(f"link {link}")


def fit(rows: DataFrame, problems: list[Problem], scaled: bool = True, rounds: int = ROUNDS) -> list[Problem]:
    """Fits all problems; their own coefficients are where they start, if they have some. The ridge weighs as the mean weight of a row
    does, and leaves out the intercept. Columns that are collinear share their effect."""
    if any(p.mean is None for p in problems):
        if scaled:
            scale(rows, problems)
        else:
            for p in problems:
                p.mean, p.std = np.zeros(len(p.cols)), np.ones(len(p.cols))
    for p in problems:
        p.settled = False
    for _ in range(rounds):
        todo = [p for p in problems if not p.settled]
        if not todo:
            break

        def one(x, y, t, offset, todo=todo):
            for k, p in enumerate(todo):
                own = slice(None) if p.before is None else t < p.before
                z = np.hstack(((x[own][:, p.cols] - p.mean) / p.std, np.ones((len(y[own]), 1))))
                off = offset[own]
                if p.beta is None:
                    rate = np.maximum(y[own], 0.1)
                    eta, slope = (np.log(rate), rate) if p.link == "log" else (np.sqrt(rate), 2 * np.sqrt(rate))
                else:
                    eta = z @ p.beta + off
                    rate, slope = rate_and_slope(eta, p.link)
                weight = slope * slope / rate
                target = eta - off + (y[own] - rate) / slope
                yield k, np.concatenate(((z * weight[:, None]).T.dot(z).ravel(), z.T.dot(weight * target), [weight.sum()]))

        sums = _summed(rows, one, len(todo))
        for k, p in enumerate(todo):
            d = len(p.cols) + 1
            gram, right, total = sums[k][: d * d].reshape(d, d), sums[k][d * d : -1], sums[k][-1]
            gram = gram + np.diag([p.reg * total] * (d - 1) + [0.0])
            p.covariance = np.linalg.pinv(gram, hermitian=True)
            new = p.covariance @ right
            p.settled = p.beta is not None and bool(np.max(np.abs(new - p.beta)) <= TOLERANCE * (1 + np.max(np.abs(new))))
            p.beta = new
    return problems


def predicted(p: Problem, x: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Rates with the log rate inside its bounds."""
    eta = ((x[:, p.cols] - p.mean) / p.std) @ p.beta[:-1] + p.beta[-1] + offset
    if p.link == "log":
        return np.exp(np.clip(eta, LOW, HIGH))
    return np.clip(eta * eta, np.exp(LOW), np.exp(HIGH))


def losses(rows: DataFrame, problems: list[Problem]) -> np.ndarray:
    """n, sum of squared errors, sum of Poisson deviances of each model on all rows; one scan."""

    def one(x, y, t, offset):
        for k, p in enumerate(problems):
            rate = predicted(p, x, offset)
            own = np.where(y > 0, y * np.log(np.where(y > 0, y, 1.0) / rate), 0.0)
            yield k, np.array([len(y), np.sum((y - rate) ** 2), 2 * np.sum(own - (y - rate))])

    sums = _summed(rows, one, len(problems))
    return np.array([sums[k] for k in range(len(problems))])


def distances(rows: DataFrame, problems: list[Problem], full: Problem) -> np.ndarray:
    """Mean squared distance of each model's rates from those of another one; one scan."""

    def one(x, y, t, offset):
        target = predicted(full, x, offset)
        for k, p in enumerate(problems):
            yield k, np.array([len(y), np.sum((target - predicted(p, x, offset)) ** 2)])

    sums = _summed(rows, one, len(problems))
    return np.array([sums[k][1] / sums[k][0] for k in range(len(problems))])


def expected(rows: DataFrame, full: Problem) -> DataFrame:
    """rows whose y is the model's rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, _, _, offset = _arrays(b)
                yield pa.RecordBatch.from_arrays([b.column("x"), pa.array(predicted(full, x, offset)), b.column("t"), b.column("offset")], names=["x", "y", "t", "offset"])

    return rows.select("x", "y", "t", "offset").mapInArrow(run, "x array<double>, y double, t long, offset double")
