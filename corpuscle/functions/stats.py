"""Corpus statistics as column expressions.

Counts are cast to double before they are multiplied, and every quotient and logarithm is guarded, so
that ANSI mode neither raises nor turns an infinity into null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def dbl(x: Column | float | str) -> Column:
    if isinstance(x, str):
        x = F.col(x)
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def xlogy(x: Column, y: Column) -> Column:
    """x * ln(y), and 0 where x is 0."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.ln(y))


def ratio(a: Column, b: Column) -> Column:
    """a / b, with infinities and NaN where b is 0."""
    return F.when(b == 0, F.when(a > 0, INF).when(a < 0, -INF).otherwise(NAN)).otherwise(a / b)


def expected(a: Column, b: Column, n_a: Column, n_b: Column) -> tuple[Column, Column]:
    """Counts expected on either side if the term's rate were the same on both."""
    share = (a + b) / (n_a + n_b)
    return n_a * share, n_b * share


def g2(a, b, n_a, n_b, formula: str = "rayson") -> Column:
    """Signed log-likelihood; positive where the rate on side a is at least that on side b."""
    if formula not in ("rayson", "dunning"):
        raise ValueError(f"formula is 'rayson' or 'dunning', not {formula!r}")
    a, b, n_a, n_b = map(dbl, (a, b, n_a, n_b))
    e_a, e_b = expected(a, b, n_a, n_b)
    total = xlogy(a, a / F.when(e_a == 0, 1.0).otherwise(e_a)) + xlogy(b, b / F.when(e_b == 0, 1.0).otherwise(e_b))
    if formula == "dunning":
        c, d = n_a - a, n_b - b
        f_a, f_b = expected(c, d, n_a, n_b)
        total = total + xlogy(c, c / F.when(f_a == 0, 1.0).otherwise(f_a)) + xlogy(d, d / F.when(f_b == 0, 1.0).otherwise(f_b))
    size = F.greatest(2 * total, F.lit(0.0))
    return F.when(a / n_a >= b / n_b, size).otherwise(-size)


def chi_squared(a, b, n_a, n_b) -> Column:
    """Signed Pearson statistic of the 2 x 2 table."""
    a, b, n_a, n_b = map(dbl, (a, b, n_a, n_b))
    c, d = n_a - a, n_b - b
    under = (a + b) * (c + d) * n_a * n_b
    size = F.when(under == 0, 0.0).otherwise((a * d - b * c) * (a * d - b * c) * (n_a + n_b) / F.when(under == 0, 1.0).otherwise(under))
    return F.when(a / n_a >= b / n_b, size).otherwise(-size)


def log_ratio(a, b, n_a, n_b, smoothing: float = 0.5) -> Column:
    if smoothing <= 0:
        raise ValueError("smoothing must be positive")
    a, b, n_a, n_b = map(dbl, (a, b, n_a, n_b))
    return F.log2(((a + smoothing) / n_a) / ((b + smoothing) / n_b))


def percent_diff(a, b, n_a, n_b) -> Column:
    """Change of the rate from b to a in percent; infinite where b is 0 and a is not, NaN where both are."""
    a, b, n_a, n_b = map(dbl, (a, b, n_a, n_b))
    return F.when(b == 0, F.when(a > 0, INF).otherwise(NAN)).otherwise(
        (a / n_a - b / n_b) / (F.when(b == 0, 1.0).otherwise(b) / n_b) * 100
    )


def bayes_factor(a, b, n_a, n_b, formula: str = "rayson") -> Column:
    """BIC approximation: exp((|G2| - ln N) / 2); infinite where it overflows."""
    n = dbl(n_a) + dbl(n_b)
    return F.exp((F.abs(g2(a, b, n_a, n_b, formula)) - F.ln(n)) / 2)


def g2_many(counts: Sequence[Column], totals: Sequence[float]) -> Column:
    """Unsigned log-likelihood of a term over any number of corpora."""
    counts = [dbl(c) for c in counts]
    both, n = sum(counts[1:], counts[0]), float(sum(totals))
    parts = [xlogy(c, c * n / (F.when(both == 0, 1.0).otherwise(both) * t)) for c, t in zip(counts, totals)]
    return F.greatest(2 * sum(parts[1:], parts[0]), F.lit(0.0))


def log_dice(f_xy, f_x, f_y) -> Column:
    f_xy, f_x, f_y = map(dbl, (f_xy, f_x, f_y))
    return 14 + _log2(2 * f_xy / (f_x + f_y))


def pmi(f_xy, f_x, f_y, n) -> Column:
    f_xy, f_x, f_y, n = map(dbl, (f_xy, f_x, f_y, n))
    return _log2(ratio(f_xy * n, f_x * f_y))


def t_score(f_xy, f_x, f_y, n) -> Column:
    f_xy, f_x, f_y, n = map(dbl, (f_xy, f_x, f_y, n))
    return ratio(f_xy - f_x * f_y / n, F.sqrt(f_xy))


def mi3(f_xy, f_x, f_y, n) -> Column:
    f_xy, f_x, f_y, n = map(dbl, (f_xy, f_x, f_y, n))
    return _log2(ratio(f_xy * f_xy * f_xy * n, f_x * f_y))


def _log2(x: Column) -> Column:
    return F.when(x == 0, -INF).otherwise(F.log2(x))


MEASURES = ("logDice", "PMI", "t-score", "MI3")


def association(measure: str, f_xy, f_x, f_y, n) -> Column:
    found = {
        "logDice": lambda: log_dice(f_xy, f_x, f_y),
        "PMI": lambda: pmi(f_xy, f_x, f_y, n),
        "t-score": lambda: t_score(f_xy, f_x, f_y, n),
        "MI3": lambda: mi3(f_xy, f_x, f_y, n),
    }
    if measure not in found:
        raise ValueError(f"measure is one of {', '.join(MEASURES)}, not {measure!r}")
    return found[measure]()


def z_of(confidence: float) -> float:
    if not 0 < confidence < 1:
        raise ValueError("a confidence level lies between 0 and 1")
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def wilson(x, n, confidence: float = 0.95) -> tuple[Column, Column]:
    """Bounds of Wilson's interval for x of n; NaN where n is 0."""
    z = z_of(confidence)
    x, n = dbl(x), dbl(n)
    safe = F.when(n == 0, 1.0).otherwise(n)
    p = x / safe
    under = 1 + z * z / safe
    mid = (p + z * z / (2 * safe)) / under
    half = z / under * F.sqrt(F.greatest(p * (1 - p) / safe + z * z / (4 * safe * safe), F.lit(0.0)))
    clip = lambda c: F.when(n == 0, NAN).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    return clip(mid - half), clip(mid + half)


def wilson_interval(x: float, n: float, confidence: float = 0.95) -> tuple[float, float]:
    """The same for two numbers."""
    if x < 0 or n < 0 or x > n:
        raise ValueError("an interval needs 0 <= x <= n")
    if n == 0:
        return NAN, NAN
    z, p = z_of(confidence), x / n
    under = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / under
    half = z / under * math.sqrt(max(0.0, p * (1 - p) / n + z * z / (4 * n * n)))
    return max(0.0, mid - half), min(1.0, mid + half)


def dot(a, b) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine of two arrays; 0 where one has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.when(n == 0, 1.0).otherwise(n))
