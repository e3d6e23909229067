"""Student's t and the normal distribution in plain Python: one value for each group, so no vectorised library is needed."""

from __future__ import annotations

import math


def _continued_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _continued_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _continued_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    """Chance of a value of at least |t| to either side."""
    if dof <= 0 or math.isnan(t):
        return math.nan
    return 0.0 if math.isinf(t) else incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


def t_quantile(p: float, dof: float) -> float:
    """The value with chance p below it, by bisection."""
    if not 0 < p < 1 or dof <= 0:
        return math.nan
    if p < 0.5:
        return -t_quantile(1 - p, dof)
    low, high = 0.0, 1.0
    while t_two_sided(high, dof) > 2 * (1 - p):
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, dof) > 2 * (1 - p) else (low, mid)
    return (low + high) / 2


def spearman_p(rho: float, n: int) -> float:
    """Two-sided chance of a rank correlation of at least |rho| among n values, by t with n - 2 degrees of freedom."""
    if n < 3 or rho is None or math.isnan(rho):
        return math.nan
    return 0.0 if abs(rho) >= 1 else t_two_sided(rho * math.sqrt((n - 2) / ((1 - rho) * (1 + rho))), n - 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
