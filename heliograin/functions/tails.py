"""Tail probabilities of test statistics as columns.

A tail is the ratio of two integrals of one density, over the tail and over the
whole, each by Simpson's rule between the points where the density matters. In
the angles and roots used here densities are smooth, and they are scaled by
their peak, so no gamma function is needed and nothing under- or overflows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of Simpson's rule (even), and how many standard widths from the peak a density is followed.
STEPS, WIDTH = 400, 12.0


def _integral(low: Column, high: Column, log_density: Callable[[Column], Column]) -> Column:
    step = (high - low) / STEPS
    part = lambda acc, k: acc + F.when((k == 0) | (k == STEPS), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0) * F.exp(log_density(low + k * step))
    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), part) * step / 3


def _ln(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-300)))


def _tail(at: Column, peak: Column, width: Column, lowest: Column, highest: Column, log_density: Callable[[Column], Column]) -> Column:
    scaled = lambda x: log_density(x) - log_density(peak)
    low, high = F.greatest(peak - width, lowest), F.least(peak + width, highest)
    end = F.least(F.greatest(peak, at) + width, highest)
    return F.least(F.when(at <= low, 1.0).otherwise(_integral(at, end, scaled) / _integral(low, high, scaled)), F.lit(1.0))


def chi_square_tail(x: Column, dof: Column) -> Column:
    """P(X >= x) of the chi-square law; null for no degrees of freedom."""
    k, at = dof.cast("double") - 1, F.sqrt(F.greatest(x, F.lit(0.0)))
    tail = _tail(at, F.sqrt(k), F.lit(WIDTH), F.lit(0.0), F.lit(1e300), lambda s: k * _ln(s) - s * s / 2)
    return F.when(dof > 0, tail)


def f_tail(x: Column, dof1: Column, dof2: Column) -> Column:
    """P(X >= x) of the F law, over the angle whose squared tangent is x * dof1 / dof2."""
    a, b = dof1.cast("double") - 1, dof2.cast("double") - 1
    at = F.atan(F.sqrt(F.greatest(x, F.lit(0.0)) * dof1 / dof2))
    peak = F.atan2(F.sqrt(a), F.sqrt(b))
    width = WIDTH / F.sqrt(a + b + 1)
    tail = _tail(at, peak, width, F.lit(0.0), F.lit(math.pi / 2), lambda p: a * _ln(F.sin(p)) + b * _ln(F.cos(p)))
    return F.when((dof1 >= 1) & (dof2 >= 1), tail)


def t_tail(t: Column, dof: Column, tail: str = "two-sided") -> Column:
    """P-value of Student's t: two-sided, greater or less."""
    both = f_tail(t * t, F.lit(1), dof)
    if tail == "two-sided":
        return both
    beyond = F.when(t >= 0, both / 2).otherwise(1 - both / 2)
    return beyond if tail == "greater" else 1 - beyond


def kolmogorov_tail(d: Column, n: Column) -> Column:
    """Asymptotic p-value of the one-sample distance, with the small-sample correction of the root of n."""
    root = F.sqrt(n.cast("double"))
    scaled = (root + 0.12 + 0.11 / root) * d
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * scaled * scaled))
    return F.when(scaled < 0.2, 1.0).otherwise(F.least(F.greatest(terms, F.lit(0.0)), F.lit(1.0)))
