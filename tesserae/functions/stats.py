"""Normal and Poisson expressions, and uniforms that any engine can reproduce."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_pdf(z: Column) -> Column:
    """F6."""
    return F.exp(-z * z / 2) / F.sqrt(2 * F.pi())


#: Abramowitz and Stegun, formula 7.1.26 (error below 1.5e-7).
_ERF_P, _ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    t = 1 / (1 + _ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(_ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(z: Column) -> Column:
    """F6."""
    return (1 + erf(z / F.sqrt(F.lit(2.0)))) / 2


def uniform(*keys) -> Column:
    """A number in [0, 1) from the md5 of keys joined by "|"."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


#: Acklam's rational approximation of the normal quantile (relative error below 1.2e-9).
_Q_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_Q_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_Q_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_Q_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_Q_TAIL = 0.02425


def _polynomial(factors: tuple, x: Column) -> Column:
    out = F.lit(factors[0])
    for f in factors[1:]:
        out = out * x + f
    return out


def normal_quantile(u: Column) -> Column:
    """The z below which a standard normal lies with probability u, for u within (0, 1)."""
    q = u - 0.5
    middle = _polynomial(_Q_A, q * q) * q / _polynomial(_Q_B, q * q)
    far = F.sqrt(-2 * F.log(F.least(u, 1 - u)))
    tail = _polynomial(_Q_C, far) / _polynomial(_Q_D, far)
    return F.when(F.least(u, 1 - u) >= _Q_TAIL, middle).otherwise(F.when(u < 0.5, tail).otherwise(-tail))


def _poisson_counts(u: np.ndarray, rate: np.ndarray) -> np.ndarray:
    # what lies more than ten deviations below a rate is under one part in 2^70 and is left out
    low = np.maximum(0, np.floor(rate - 10 * np.sqrt(rate) - 10))
    p = np.exp(np.where(low > 0, low * np.log(rate) - rate - np.array([math.lgamma(k + 1) for k in low]), -rate))
    below, count, k = p.copy(), low.astype(np.int64), low.copy()
    last = rate * 2 + 12 * np.sqrt(rate) + 60
    todo = np.flatnonzero((below <= u) & (rate > 0))
    while len(todo):
        k[todo] += 1
        p[todo] *= rate[todo] / k[todo]
        below[todo] += p[todo]
        count[todo] += 1
        todo = todo[(below[todo] <= u[todo]) & (k[todo] < last[todo])]
    return count


def poisson_quantile(u: Column, rate: Column) -> Column:
    """M11. The count at which the distribution function first exceeds u, for any rate; null where u or rate is null."""

    @F.pandas_udf("long")
    def counts(us: pd.Series, rates: pd.Series) -> pd.Series:
        known = (us.notna() & rates.notna()).to_numpy()
        out = pd.Series(pd.NA, index=us.index, dtype="Int64")
        out[known] = _poisson_counts(us.to_numpy(float)[known], rates.to_numpy(float)[known])
        return out

    return counts(u.cast("double"), rate.cast("double"))
