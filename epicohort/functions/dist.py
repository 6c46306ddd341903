"""Tail probabilities that the model tables need, on driver scalars."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(160)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _t_tail(x: float, dof: float) -> float:
    """Student t's tail beyond x >= 0, up to a constant.  With t = sqrt(dof) tan(u)
    the density is cos(u) ** (dof - 1); the tail is summed over pieces that each
    hold a smooth part of it."""
    edges = [x, x + 1, x + 3, x + 7, x + 15, 4 * x + 40, 64 * x + 1e3, 1e5 * (x + 1), 1e18]
    total = 0.0
    for a, b in zip(edges, edges[1:]):
        lo, hi = math.atan(a / math.sqrt(dof)), math.atan(b / math.sqrt(dof))
        u = lo + (hi - lo) * (_NODES + 1) / 2
        total += (hi - lo) / 2 * float(_WEIGHTS @ np.exp((dof - 1) * np.log(np.cos(u))))
    return total


def t_two_sided(stat: float, dof: float) -> float:
    """P(|T| > |stat|) for Student t."""
    return min(1.0, _t_tail(abs(stat), dof) / _t_tail(0.0, dof))


@lru_cache(maxsize=4096)
def t_quantile_975(dof: float) -> float:
    """The point that Student t exceeds with probability 0.025, by bisection."""
    lo, hi = 1.9, 13.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, dof) > 0.05 else (lo, mid)
    return (lo + hi) / 2


def chi2_upper(x: float, dof: int) -> float:
    """P(X > x) for chi-square with whole degrees of freedom: a finite series
    (Poisson terms for even, half-integer terms beside erfc for odd degrees)."""
    if x <= 0:
        return 1.0
    half = x / 2
    logs = [k * math.log(half) - half - math.lgamma(k + 1) for k in np.arange(dof % 2 / 2, dof / 2, 1.0)]
    start = math.erfc(math.sqrt(half)) if dof % 2 else 0.0
    return min(1.0, start + sum(math.exp(v) for v in logs))
