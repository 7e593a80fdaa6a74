"""Distribution functions for p-values, evaluated inside Spark tasks.

Spark SQL has no chi-square, F or normal CDF and SciPy is not available.  All
tests here have whole numbers of degrees of freedom, so the tails are finite
sums (Abramowitz & Stegun 26.4.4, 26.4.5 and the recurrences 26.5.15, 26.5.16 of
the incomplete beta function) that start from closed forms; only the tail of
Student's t is integrated numerically.  They run on the small result rows of a
test (one row per series or pair), never on the data.

Published approximations used (fixed values, stated as in the literature):
- Anderson-Darling p for a normal with estimated mean and variance
  (D'Agostino & Stephens 1986).
- MacKinnon (1994) surface for the ADF test with a constant.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(80)
_SMOOTH = 20.0  # the t integral starts from at least this first parameter


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in np.atleast_1d(x)])


def _whole(*numbers: float) -> bool:
    return all(v is not None and not np.isnan(v) and v == int(v) and v >= 1 for v in numbers)


def chi2_sf(x: float, dof: float) -> float:
    """P(X > x) for a chi-square with ``dof`` (whole) degrees of freedom."""
    if x is None or np.isnan(x) or not _whole(dof):
        return float("nan")
    if x <= 0:
        return 1.0
    half, odd = x / 2.0, int(dof) % 2
    i = np.arange(1, int(dof) // 2 + 1) - (0.5 if odd else 1.0)  # powers of the sum's terms
    tail = float(np.exp(i * math.log(half) - half - _log_gamma(i + 1.0)).sum()) if len(i) else 0.0
    return min(1.0, tail + (math.erfc(math.sqrt(half)) if odd else 0.0))


def _log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def _beta_to_half(a: float, x: float) -> float:
    """I_x(a, 1/2), 0 < x < 1: the two-sided tail of Student's t with 2a
    degrees of freedom.  Steps in ``a`` reach a smooth integrand."""
    total = 0.0
    while a < _SMOOTH:
        total += math.exp(a * math.log(x) + 0.5 * math.log1p(-x) - math.log(a) - _log_beta(a, 0.5))
        a += 1.0
    # 2 / B * integral of (1 - v^2)^(a-1) from sqrt(1 - x) to where it has all but vanished
    v0 = math.sqrt(1.0 - x)
    v1 = math.sqrt(1.0 - x * 10.0 ** (-20.0 / (a - 1.0)))
    v = v0 + (v1 - v0) * (_NODES + 1.0) / 2.0
    area = float((_WEIGHTS * np.exp((a - 1.0) * (np.log1p(-v * v) - math.log(x)))).sum()) * (v1 - v0) / 2.0
    return total + 2.0 * area * math.exp((a - 1.0) * math.log(x) - _log_beta(a, 0.5))


def f_sf(x: float, d1: float, d2: float) -> float:
    """P(X > x) for an F distribution with whole degrees of freedom."""
    if x is None or np.isnan(x) or not _whole(d1, d2):
        return float("nan")
    if x <= 0:
        return 1.0
    a, w = d2 / 2.0, d2 / (d2 + d1 * x)
    if not 0.0 < w < 1.0:
        return 1.0 if w >= 1.0 else 0.0
    # I_w(d2 / 2, d1 / 2): upwards from a second parameter of 1/2 or 1
    b, total = (0.5, _beta_to_half(a, w)) if int(d1) % 2 else (1.0, w ** a)
    while b < d1 / 2.0:
        total += math.exp(a * math.log(w) + b * math.log1p(-w) - math.log(b) - _log_beta(a, b))
        b += 1.0
    return min(1.0, total)


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def ad_normal_pvalue(a2: float, n: float) -> float:
    """Anderson-Darling p for normality with estimated mean and variance."""
    if a2 is None or np.isnan(a2) or n is None or n <= 0:
        return float("nan")
    a = a2 * (1.0 + 0.75 / n + 2.25 / n ** 2)
    # D'Agostino & Stephens (1986) piecewise p-value formula.
    if a < 0.2:
        return 1.0 - math.exp(-13.436 + 101.14 * a - 223.73 * a ** 2)
    if a < 0.34:
        return 1.0 - math.exp(-8.318 + 42.796 * a - 59.938 * a ** 2)
    if a < 0.6:
        return math.exp(0.9177 - 4.279 * a - 1.38 * a ** 2)
    if a <= 13:
        return math.exp(1.2937 - 5.709 * a + 0.0186 * a ** 2)
    return 0.0


def mackinnon_p_constant(t: float) -> float:
    """MacKinnon (1994) approximate p for the ADF t-statistic, constant only."""
    if t is None or np.isnan(t):
        return float("nan")
    # MacKinnon (1994) response surface, one series, constant.
    if t > 2.74:
        return 1.0
    if t < -18.83:
        return 0.0
    if t <= -1.61:
        poly = 2.1659 + 1.4412 * t + 0.038269 * t ** 2
    else:
        poly = 1.7339 + 0.93202 * t - 0.12745 * t ** 2 - 0.010368 * t ** 3
    return norm_cdf(poly)


def log_norm_cdf(z: float) -> float:
    """ln of the standard normal distribution function, for any finite z."""
    if np.isnan(z):
        return float("nan")
    if z > -10.0:
        return math.log(0.5 * math.erfc(-z / math.sqrt(2.0)))
    w = 1.0 / (z * z)
    return -0.5 * z * z - math.log(-z) - 0.5 * math.log(2 * math.pi) + math.log1p(-w * (1 - 3 * w * (1 - 5 * w)))


def _vec(fn, *series: pd.Series) -> pd.Series:
    vals = [s.astype("float64").to_numpy() for s in series]
    out = [fn(*args) for args in zip(*vals)]
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def chi2_sf_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _vec(chi2_sf, x, dof)


@F.pandas_udf(DoubleType())
def log_norm_cdf_pair_udf(z: pd.Series) -> pd.Series:
    """ln P(z): through erfc, and by the tail's asymptotic series where erfc
    would underflow."""
    return pd.Series([log_norm_cdf(v) for v in z.astype("float64").to_numpy()], dtype="float64")


@F.pandas_udf(DoubleType())
def ad_pvalue_udf(a2: pd.Series, n: pd.Series) -> pd.Series:
    return _vec(ad_normal_pvalue, a2, n)


def chi2_sf_col(x: Column, dof: Column) -> Column:
    return chi2_sf_udf(x.cast("double"), dof.cast("double"))
