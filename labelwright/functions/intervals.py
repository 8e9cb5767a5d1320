"""Confidence intervals over aggregated counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def ratio(num: Column, den: Column, zero: float | None = 0.0) -> Column:
    """``num / den`` with ``zero`` where the denominator is 0."""
    value = F.try_divide(num.cast("double"), den.cast("double"))
    return value if zero is None else F.coalesce(value, F.lit(zero))


def wilson_bounds(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    n_, zz = n.cast("double"), z * z
    p = k / n_
    scale = 1 + zz / n_
    centre = (p + zz / (2 * n_)) / scale
    half = z * F.sqrt(p * (1 - p) / n_ + zz / (4 * n_ * n_)) / scale
    lo = F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0)
    hi = F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(1.0)
    return lo, hi


def exact_bounds(k: Column, n: Column, alpha: float = 0.05) -> Column:
    """Exact binomial interval ``struct<lo,hi>`` per (k, n) row.

    Vectorised bisection on the regularised incomplete beta function. Apply it to
    aggregated rows, one per group.
    """

    @F.pandas_udf("lo double, hi double")
    def bounds(ks: pd.Series, ns: pd.Series) -> pd.DataFrame:
        import math

        import numpy as np

        lgamma = np.vectorize(math.lgamma, otypes=[float])

        def fraction(a, b, x):
            # Lentz evaluation of the continued fraction, for x < (a + 1) / (a + b + 2)
            tiny = 1e-300
            c = np.ones_like(x)
            d = 1 - (a + b) * x / (a + 1)
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            h = d.copy()
            for m in range(1, 5000):
                for top in (
                    m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
                ):
                    d = 1 + top * d
                    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                    c = 1 + top / np.where(np.abs(c) < tiny, tiny, c)
                    h = h * d * c
                if np.all(np.abs(d * c - 1) < 1e-15):
                    return h
            raise ArithmeticError("the continued fraction of the incomplete beta function did not converge")

        def beta_cdf(a, b, x):
            with np.errstate(divide="ignore", invalid="ignore", over="ignore", under="ignore"):
                log_front = lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)
                low = x < (a + 1) / (a + b + 2)
                aa, bb, xx = np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1 - x)
                part = np.exp(log_front) * fraction(aa, bb, xx) / aa
            return np.where(low, part, 1 - part)

        def beta_quantile(a, b, q):
            lo, hi = np.zeros_like(a), np.ones_like(a)
            for _ in range(80):
                mid = (lo + hi) / 2
                below = beta_cdf(a, b, mid) < q
                lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
            return (lo + hi) / 2

        kk, nn = ks.to_numpy(dtype=float), ns.to_numpy(dtype=float)
        lo, hi = np.zeros(len(kk)), np.ones(len(kk))
        has_lo, has_hi = (nn > 0) & (kk > 0), (nn > 0) & (kk < nn)
        if has_lo.any():
            lo[has_lo] = beta_quantile(kk[has_lo], nn[has_lo] - kk[has_lo] + 1, alpha / 2)
        if has_hi.any():
            hi[has_hi] = beta_quantile(kk[has_hi] + 1, nn[has_hi] - kk[has_hi], 1 - alpha / 2)
        return pd.DataFrame({"lo": lo, "hi": hi})

    return bounds(k, n)
