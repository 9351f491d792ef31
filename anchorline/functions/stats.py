"""Closed-form statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Rational approximation 26.2.17 of Abramowitz and Stegun, absolute error < 7.5e-8.
_P = 0.2316419
_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
_INV_SQRT_2PI = 0.3989422804014327


def normal_sf(z: Column) -> Column:
    """P(Z > z) for z >= 0, standard normal."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(_P) * z)
    poly = F.lit(0.0)
    for b in reversed(_B):
        poly = t * (F.lit(b) + poly)
    return F.lit(_INV_SQRT_2PI) * F.exp(-z * z / F.lit(2.0)) * poly


def two_sided_p(z: Column) -> Column:
    return F.lit(2.0) * normal_sf(F.abs(z))


def two_proportion_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Pooled two-sample proportion statistic; NULL where either sample or the variance is empty."""
    pooled = (x1 + x2) / (n1 + n2).cast("double")
    variance = pooled * (1 - pooled) * (F.lit(1.0) / n1 + F.lit(1.0) / n2)
    return F.when(
        (n1 > 0) & (n2 > 0),
        F.try_divide(x1 / n1.cast("double") - x2 / n2.cast("double"), F.when(variance > 0, F.sqrt(variance))),
    )


def kolmogorov_p(statistic: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    lam = statistic * F.sqrt(n1.cast("double") * n2 / (n1 + n2))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    return F.when(lam < 0.1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series)))


def psi_term(actual: Column, expected: Column) -> Column:
    return (actual - expected) * F.ln(actual / expected)
