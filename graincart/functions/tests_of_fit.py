"""p-values of the tests of fit, for the few rows that hold a statistic."""

from __future__ import annotations

import math

import numpy as np

#: Up to this size of either side the p-value of Kolmogorov and Smirnov's test is exact.
EXACT = 10_000


def kolmogorov_smirnov(statistic: float | None, n: int, m: int, exact_up_to: int = EXACT) -> float | None:
    """The chance that two samples of ``n`` and ``m`` draws of one distribution lie at least ``statistic`` apart.

    Exact by counting the orders of the draws that stay closer, if both sides are small enough; else
    by the limit distribution. None without a statistic or draws.
    """
    if statistic is None or n < 1 or m < 1:
        return None
    if max(n, m) > exact_up_to:
        x = statistic * math.sqrt(n * m / (n + m))
        if x < 0.2:
            return 1.0
        return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))
    # the distance of place (i, j) in whole steps of 1 / lcm
    common = n * m // math.gcd(n, m)
    most = round(statistic * common)
    if most <= 0:
        return 1.0
    up, right = common // n, common // m
    columns = np.arange(m + 1)
    logs, row = 0.0, (columns * right < most).astype(float)
    for i in range(1, n + 1):
        inside = np.abs(i * up - columns * right) < most
        row = np.where(inside, row, 0.0)
        # places within reach stand in one run, so that sums along it give the ways to each
        row = np.where(inside, np.cumsum(row), 0.0)
        top = row.max()
        if top == 0:
            return 1.0
        row, logs = row / top, logs + math.log(top)
    if row[m] == 0:
        return 1.0
    logs += math.log(row[m]) - (math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1))
    return min(1.0, max(0.0, -math.expm1(min(logs, 0.0))))


def chi_square_tail(statistic: float | None, dof: int) -> float | None:
    """The chance of a chi-square value of ``dof`` degrees of freedom above ``statistic``; None without degrees."""
    if statistic is None or dof < 1 or statistic != statistic:
        return None
    a, x = dof / 2, statistic / 2
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    b, c, tiny = x + 1 - a, 1e300, 1e-300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = step * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + step / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h
