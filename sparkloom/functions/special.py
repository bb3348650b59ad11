"""Distribution functions on numbers: regularised gamma and beta, t, F, chi-square and normal tails."""

from __future__ import annotations

import math


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * scale


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(100_000):
        m = i // 2
        if i == 0:
            top = 1.0
        elif i % 2 == 0:
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            top = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + top * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + top / c
        c = c if abs(c) > tiny else tiny
        f *= c * d
        if i and abs(1 - c * d) < 1e-16:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    return beta_inc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)
