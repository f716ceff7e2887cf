"""Distributions for tests on moments that Spark has aggregated: Student's t, the normal, and exact signed ranks."""

from __future__ import annotations

import math


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(500):  # modified Lentz
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + term * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + term / c
        c = c if abs(c) > tiny else tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_above(t: float, df: float) -> float:
    """P(T > t)."""
    tail = beta_share(df / 2, 0.5, df / (df + t * t)) / 2
    return tail if t >= 0 else 1 - tail


def t_quantile(p: float, df: float) -> float:
    lo, hi = -1.0, 1.0
    while t_above(lo, df) < 1 - p:
        lo *= 2
    while t_above(hi, df) > 1 - p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_above(mid, df) > 1 - p else (lo, mid)
    return (lo + hi) / 2


def t_p(t: float, df: float, alternative: str = "two-sided") -> float:
    return {"two-sided": min(1.0, 2 * t_above(abs(t), df)), "greater": t_above(t, df), "less": t_above(-t, df)}[alternative]


def normal_above(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def wilcoxon_p(w_plus: float, n: int, squares: float, tied: bool, alternative: str = "two-sided") -> float:
    """Of the sum of positive ranks among ``n``: exact to 50 without ties, else normal by the sum of squared ranks."""
    if n <= 50 and not tied:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):  # each rank is positive or not
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        all_ways = 2.0**n
        above, below = sum(ways[math.ceil(w_plus) :]) / all_ways, sum(ways[: math.floor(w_plus) + 1]) / all_ways
    else:
        z = (w_plus - n * (n + 1) / 4) / math.sqrt(squares / 4)
        above, below = normal_above(z), normal_above(-z)
    return {"two-sided": min(1.0, 2 * min(above, below)), "greater": above, "less": below}[alternative]


def p_text(p: float | None) -> str:
    return "n/a" if p is None or p != p else "<0.001" if p < 0.001 else f"{p:.3f}"


def mean_sd_text(mean: float, sd: float | None, digits: int = 3) -> str:
    return f"{mean:.{digits}f}" if sd is None else f"{mean:.{digits}f}±{sd:.{digits}f}"
