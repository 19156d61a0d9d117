"""Quantiles of Student's t as a small table: no engine has them built in."""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degrees of freedom that the table lists; beyond, an expansion is exact to 1e-9.
TABLE = 300


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    f, c, d, tiny = 1.0, 1.0, 0.0, 1e-300
    for k in range(400):
        m = k // 2
        if k == 0:
            top = 1.0
        elif k % 2 == 0:
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            top = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or tiny)
        c = 1 + top / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-16:
            break
    return front * (f - 1)


def quantile(p: float, dof: int) -> float:
    """The t below which a share ``p`` of the distribution lies, 0.5 <= p < 1, by bisection."""
    below = lambda t: 1 - 0.5 * _beta(dof / 2, 0.5, dof / (dof + t * t))
    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return (low + high) / 2


@cache
def critical(confidence: float) -> tuple[float, ...]:
    """Two-sided critical values for 1 to ``TABLE`` degrees of freedom."""
    return tuple(quantile((1 + confidence) / 2, dof) for dof in range(1, TABLE + 1))


def tcrit(confidence: float, dof: Column) -> Column:
    """The two-sided critical value: from the table, which stands in the plan as a constant, or the expansion beyond it."""
    listed = F.array(*[F.lit(t) for t in critical(confidence)])
    return F.when(dof.between(1, TABLE), F.try_element_at(listed, dof.cast("int"))).when(dof > TABLE, beyond(confidence, dof.cast("double")))


def expansion(confidence: float) -> tuple[tuple[float, float, float], float]:
    """The terms in 1 / dof, its square and its cube, and the normal quantile that they are added to."""
    p, low, high = (1 + confidence) / 2, 0.0, 40.0
    for _ in range(200):
        z = (low + high) / 2
        low, high = (z, high) if 0.5 * math.erfc(-z / math.sqrt(2)) < p else (low, z)
    z = (low + high) / 2
    return ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384), z


def beyond(confidence: float, dof: Column) -> Column:
    """Critical values beyond the table, as an expansion around the normal quantile."""
    terms, z = expansion(confidence)
    return F.lit(z) + F.lit(terms[0]) / dof + F.lit(terms[1]) / (dof * dof) + F.lit(terms[2]) / (dof * dof * dof)
