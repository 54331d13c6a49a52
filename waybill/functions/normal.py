"""Normal distribution function and its inverse as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: Acklam's rational approximation of the inverse -----------------
INVERSE_A = [
    -3.969683028665376e01,
    2.209460984245205e02,
    -2.759285104469687e02,
    1.383577518672690e02,
    -3.066479806614716e01,
    2.506628277459239e00,
]
INVERSE_B = [
    -5.447609879822406e01,
    1.615858368580409e02,
    -1.556989798598866e02,
    6.680131188771972e01,
    -1.328068155288572e01,
]
INVERSE_C = [
    -7.784894002430293e-03,
    -3.223964580411365e-01,
    -2.400758277161838e00,
    -2.549732539343734e00,
    4.374664141464968e00,
    2.938163982698783e00,
]
INVERSE_D = [
    7.784695709041462e-03,
    3.224671290700398e-01,
    2.445134137142996e00,
    3.754408661907416e00,
]
INVERSE_TAIL = 0.02425

# ---- Fixed values: Abramowitz & Stegun 26.2.17 for the distribution function ------
CDF_P = 0.2316419
CDF_B = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
INV_SQRT_2PI = 0.3989422804014327


def _polynomial(coefficients, x: Column) -> Column:
    """Horner form, highest power first."""
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function, relative error below 1.2e-9."""
    q_mid = p - F.lit(0.5)
    r = q_mid * q_mid
    centre = (
        _polynomial(INVERSE_A, r) * q_mid / (_polynomial(INVERSE_B, r) * r + F.lit(1.0))
    )

    def tail(mass: Column) -> Column:
        q = F.sqrt(F.lit(-2.0) * F.ln(mass))
        return _polynomial(INVERSE_C, q) / (_polynomial(INVERSE_D, q) * q + F.lit(1.0))

    return (
        F.when(p < INVERSE_TAIL, tail(p))
        .when(p > 1.0 - INVERSE_TAIL, -tail(F.lit(1.0) - p))
        .otherwise(centre)
    )


def normal_cdf(x: Column) -> Column:
    """Normal distribution function, absolute error below 7.5e-8."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(CDF_P) * F.abs(x))
    series = _polynomial(list(reversed(CDF_B)), t) * t
    upper = F.lit(INV_SQRT_2PI) * F.exp(F.lit(-0.5) * x * x) * series
    return F.when(x >= 0, F.lit(1.0) - upper).otherwise(upper)
