"""Two-sided p-value of Student's t, for the handful of aggregated rows that carry a test statistic."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# The function travels to the workers with its helpers, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEPS = 1_000_000


def _fraction(terms: Callable[[int], float]) -> float:
    """``1 + terms(1) / (1 + terms(2) / (1 + ...))``."""
    value, upper, lower = 1.0, 1.0, 0.0
    for j in range(1, STEPS):
        d = terms(j)
        lower = 1.0 / (1.0 + d * lower)
        upper = 1.0 + d / upper
        value *= upper * lower
        if abs(upper * lower - 1.0) < 1e-14:
            return value
    raise ArithmeticError("the incomplete beta function did not converge")


def _body(a: float, rest: float) -> float:
    """Fraction of the incomplete beta function of ``rest`` with 1/2 and ``a`` (DLMF 8.17.22), for small ``rest``."""
    def term(j: int) -> float:
        m = j // 2
        if j % 2:
            return -(0.5 + m) * (a + 0.5 + m) * rest / ((0.5 + 2 * m) * (1.5 + 2 * m))
        return m * (a - m) * rest / ((2 * m - 0.5) * (0.5 + 2 * m))

    return 1.0 / _fraction(term)


def _tail(a: float, ratio: float) -> float:
    """``F(1/2, 1; a + 1; -ratio)`` as Gauss's fraction: all its terms are positive, so no digits cancel."""
    def term(j: int) -> float:
        m = j // 2
        if j % 2:
            k = (0.5 + m) / (a + 1) if m == 0 else (0.5 + m) * (a + m) / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            k = m * (a + m - 0.5) / ((a + 2 * m - 1) * (a + 2 * m))
        return k * ratio

    return 1.0 / _fraction(term)


def _log_gamma_step(a: float) -> float:
    """``ln gamma(a + 1/2) - ln gamma(a)``, to full precision however large ``a`` is (DLMF 5.11.13).

    The difference of two logarithms of the gamma function loses a digit with every power of ten.
    """
    out = 0.0
    while a < 32:
        out += math.log(a / (a + 0.5))
        a += 1
    return out + 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5) + 17 / (14336 * a**7)


def _incomplete_beta(a: float, x: float, rest: float) -> float:
    """Regularised incomplete beta with ``b`` 1/2; ``rest`` is ``1 - x``, passed in so that it keeps its digits."""
    if x <= 0.0 or rest <= 0.0:
        return 0.0 if x <= 0.0 else 1.0
    # x is 1 - rest: its logarithm from the smaller of the two.
    log_x = math.log1p(-rest) if rest < 0.5 else math.log(x)
    log_front = _log_gamma_step(a) - 0.5 * math.log(math.pi) + a * log_x + 0.5 * math.log(rest)
    if rest > 1.5 / (a + 2.5):
        return math.exp(log_front) / (a * rest) * _tail(a, x / rest)
    return 1.0 - math.exp(log_front) / 0.5 * _body(a, rest)


def two_sided_p(t: float | None, df: float | None) -> float | None:
    """P(|T| >= |t|) with ``df`` degrees of freedom; None when the statistic is undefined."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return None
    return _incomplete_beta(df / 2.0, df / (df + t * t), t * t / (df + t * t))


def p_value(t: Column, df: Column) -> Column:
    """Column form of :func:`two_sided_p`."""

    @F.pandas_udf("double")
    def apply(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([two_sided_p(a, b) for a, b in zip(ts, dfs, strict=True)], dtype="float64")

    return apply(t.cast("double"), df.cast("double"))


def significance(p: Column, level: float = 0.05) -> Column:
    """Verdict on a p-value; null stays null."""
    return F.when(p < level, "significant").when(p.isNotNull(), "not significant")
