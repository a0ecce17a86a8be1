"""Column expressions for distribution functions (JVM-side, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Acklam's rational approximation of the normal quantile (relative error < 1.2e-9)
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
      -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
      -1.328068155288572e+01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
      4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]
_PLOW = 0.02425


def _horner(cs, x: Column) -> Column:
    acc = F.lit(cs[0])
    for cf in cs[1:]:
        acc = acc * x + F.lit(cf)
    return acc


def norm_ppf(p: Column) -> Column:
    """Standard normal quantile of a probability column."""
    ql = F.sqrt(-2 * F.ln(p))
    low = _horner(_C, ql) / (_horner(_D, ql) * ql + 1)
    q = p - 0.5
    r = q * q
    mid = _horner(_A, r) * q / (_horner(_B, r) * r + 1)
    qu = F.sqrt(-2 * F.ln(1 - p))
    high = -_horner(_C, qu) / (_horner(_D, qu) * qu + 1)
    return F.when(p < _PLOW, low).when(p > 1 - _PLOW, high).otherwise(mid)


# fixed values: Chebyshev fit of erfc (fractional error < 1.2e-7)
_ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398,
         1.48851587, -0.82215223, 0.17087277]


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = 1.0 / (1.0 + 0.5 * z)
    poly = F.lit(_ERFC[-1])
    for cf in reversed(_ERFC[:-1]):
        poly = poly * t + F.lit(cf)
    ans = t * F.exp(-z * z + poly)
    return F.when(x >= 0, ans).otherwise(2.0 - ans)


def norm_cdf(x: Column) -> Column:
    return 0.5 * erfc(-x / F.sqrt(F.lit(2.0)))
