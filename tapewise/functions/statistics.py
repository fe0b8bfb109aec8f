"""Distributions as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos' approximation of the gamma function for g = 7.
_LANCZOS_G = 7.0
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012,
    9.9843695780195716e-6, 1.5056327351493116e-7,
)
_TINY = 1e-300


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function of a positive number."""
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        series = series + c / (z + i)
    t = z + _LANCZOS_G + 0.5
    return 0.9189385332046727 + (z + 0.5) * F.ln(t) - t + F.ln(series) - F.ln(z)  # of z + 1, and back


def _fraction(a: Column, b: Column, x: Column, steps: Column) -> Column:
    """The continued fraction of the incomplete beta function, evaluated from the front (Lentz)."""
    bounded = lambda v: F.when(F.abs(v) < _TINY, _TINY).otherwise(v)
    first = 1 / bounded(1 - (a + b) * x / (a + 1))

    def step(s: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        term = F.when(k % 2 == 0, even).otherwise(odd)
        c, d = bounded(1 + term / s["c"]), 1 / bounded(1 + term * s["d"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(2), steps), start, step, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column, rest: Column | None = None) -> Column:
    """The regularised incomplete beta function for positive a and b and x within 0..1; the number of terms grows with the root of a and b.

    ``rest`` is 1 - x, for callers that know it better than a subtraction gives it.
    """
    rest = 1 - x if rest is None else rest
    steps = (80 + 10 * F.sqrt(F.greatest(a, b))).cast("int")
    log_x, log_rest = F.when(rest < 0.5, F.log1p(-rest)).otherwise(F.ln(x)), F.when(x < 0.5, F.log1p(-x)).otherwise(F.ln(rest))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * log_x + b * log_rest)
    inside = F.when(x < (a + 1) / (a + b + 2), front * _fraction(a, b, x, steps) / a).otherwise(1 - front * _fraction(b, a, rest, steps) / b)
    return F.when(x <= 0, 0.0).when(rest <= 0, 1.0).otherwise(inside)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with ``df`` degrees of freedom; 1 where either is null or not finite, or there are no degrees of freedom."""
    known = t.isNotNull() & df.isNotNull() & ~F.isnan(t) & ~F.isnan(df) & (F.abs(t) < float("inf")) & (df > 0) & (df < float("inf"))
    return F.when(known, incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t), t * t / (df + t * t))).otherwise(1.0)
