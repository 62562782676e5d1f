"""Differences of the log-gamma function and its derivatives, as column expressions.

Each is f(x + d) - f(x) (the trigamma one turned round, to be positive) for x of 1 or more and d
above 0.  Arguments are moved up by a fixed number of steps and then taken from the asymptotic
series.  Terms are written as differences, so that the result keeps its digits when x is far larger than d.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 10
#: Bernoulli numbers of even index, from the second to the twelfth.
BERNOULLI = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730)


def _power_gap(x: Column, y: Column, power: int) -> Column:
    """x**-power - y**-power."""
    return F.pow(x, F.lit(-power)) - F.pow(y, F.lit(-power))


def _sum(terms) -> Column:
    first, *rest = terms
    for t in rest:
        first = first + t
    return first


def log_gamma_step(x: Column, d: Column) -> Column:
    """lnGamma(x + d) - lnGamma(x): for whole d the sum of ln(x + l) over l below d."""
    near, far = x + STEPS, x + d + STEPS
    series = _sum(
        -b / (2 * k * (2 * k - 1)) * _power_gap(near, far, 2 * k - 1) for k, b in enumerate(BERNOULLI, 1)
    )
    moved = _sum(F.log1p(d / (x + k)) for k in range(STEPS))
    return d * F.ln(far) + (near - 0.5) * F.log1p(d / near) - d + series - moved


def digamma_step(x: Column, d: Column) -> Column:
    """psi(x + d) - psi(x): for whole d the sum of 1 / (x + l) over l below d."""
    near, far = x + STEPS, x + d + STEPS
    series = _sum(b / (2 * k) * _power_gap(near, far, 2 * k) for k, b in enumerate(BERNOULLI, 1))
    moved = _sum(d / ((x + k) * (x + d + k)) for k in range(STEPS))
    return F.log1p(d / near) + d / (2 * near * far) + series + moved


def trigamma_step(x: Column, d: Column) -> Column:
    """psi'(x) - psi'(x + d): for whole d the sum of 1 / (x + l)**2 over l below d."""
    near, far = x + STEPS, x + d + STEPS
    series = _sum(b * _power_gap(near, far, 2 * k + 1) for k, b in enumerate(BERNOULLI, 1))
    moved = _sum(d * (2 * x + d + 2 * k) / F.pow((x + k) * (x + d + k), F.lit(2)) for k in range(STEPS))
    return d / (near * far) + d * (near + far) / (2 * F.pow(near * far, F.lit(2))) + series + moved
