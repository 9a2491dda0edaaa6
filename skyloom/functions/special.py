"""Digamma, log-gamma and the normal distribution as Column expressions.

Arguments are shifted up to at least 6 by the recurrences, where the asymptotic
series are good to about 1e-12.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 6
# Coefficients of the two asymptotic series in powers of 1/x^2, and of
# the rational approximation of the complementary error function (Numerical Recipes, erfcc).
DIGAMMA_SERIES = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132, 691 / 32760)
LGAMMA_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
ERFC_SERIES = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _poly(x: Column, coefficients: tuple) -> Column:
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + float(c)
    return out


def digamma(x: Column) -> Column:
    """For x > 0."""
    y = x + SHIFT
    w = 1 / (y * y)
    series = F.ln(y) - 0.5 / y + w * _poly(w, DIGAMMA_SERIES)
    for k in range(SHIFT):
        series = series - 1 / (x + k)
    return series


def lgamma(x: Column) -> Column:
    """For x > 0."""
    y = x + SHIFT
    w = 1 / (y * y)
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + _poly(w, LGAMMA_SERIES) / y
    for k in range(SHIFT):
        series = series - F.ln(x + k)
    return series


def log_normal_cdf(x: Column) -> Column:
    """log Phi(x), relative error of Phi about 1e-7; exact to first order in the far tail."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.5 * z)
    log_erfc = F.ln(t) - z * z + _poly(t, ERFC_SERIES)
    tail = log_erfc - math.log(2)
    return F.when(x < 0, tail).otherwise(F.ln(1 - F.exp(tail)))


def student_t_log_density(r: Column, scale: Column, nu: float = 3.0) -> Column:
    z2 = F.pow(r / scale, 2)
    const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)
    return const - F.ln(scale) - (nu + 1) / 2 * F.log1p(z2 / nu)
