"""Chinese-restaurant seating of one dish: how many tables its customers hold."""

from __future__ import annotations

from functools import lru_cache
from statistics import NormalDist

import numpy as np

#: Up to so many customers the number of tables is drawn from its exact conditional distribution.
EXACT = 64
_normal = np.vectorize(NormalDist().inv_cdf, otypes=[float])


@lru_cache(maxsize=8)
def stirling(d: float) -> np.ndarray:
    """``log S(c, t)``: the summed weights of all seatings of ``c`` customers at ``t`` tables under discount ``d``."""
    s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    s[1, 1] = 0.0
    t = np.arange(EXACT + 1)
    for c in range(1, EXACT):
        join = np.full(EXACT + 1, -np.inf)
        join[1 : c + 1] = s[c, 1 : c + 1] + np.log(c - d * t[1 : c + 1])
        s[c + 1] = np.logaddexp(join, np.concatenate([[-np.inf], s[c, :-1]]))
    return s


def _chances(c: int, weight: np.ndarray, d: float) -> np.ndarray:
    """Rows: chances of 1 to ``c`` tables, which are in proportion to ``S(c, t) * weight ** t``."""
    x = stirling(d)[c, 1 : c + 1] + np.log(weight)[:, None] * np.arange(1, c + 1)
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _mean_beyond(c: np.ndarray, weight: np.ndarray, d: float) -> np.ndarray:
    """For many customers ``S(c, t)`` tends to a form that makes the tables but the first Poisson; this is their mean."""
    return weight * (1 - c ** -d) / d


def draw(c: np.ndarray, weight: np.ndarray, u: np.ndarray, d: float) -> np.ndarray:
    """All customers of a dish get up and are seated anew: the number of tables, by inverting its distribution at ``u``.

    ``weight`` is the strength with which the restaurant opens a table for this dish, given all others' tables."""
    c, t = np.asarray(c, np.int64), np.ones(len(c), np.int64)
    for k in np.unique(c[(c > 1) & (c <= EXACT)]).tolist():
        at = np.flatnonzero(c == k)
        t[at] = np.minimum(1 + (np.cumsum(_chances(k, weight[at], d), axis=1) < u[at, None]).sum(axis=1), k)
    big = np.flatnonzero(c > EXACT)
    if len(big):
        mean = _mean_beyond(c[big].astype(float), weight[big], d)
        some = np.maximum(np.rint(mean + np.sqrt(mean) * _normal(np.clip(u[big], 1e-12, 1 - 1e-12))), 0).astype(np.int64)
        low = np.flatnonzero(mean < 50)
        if len(low):
            m, v = mean[low], u[big][low]
            n, p = np.zeros(len(low), np.int64), np.exp(-m)
            total = p.copy()
            for k in range(1, 200):
                more = total < v
                if not more.any():
                    break
                p = p * m / k
                total += p
                n += more
            some[low] = n
        t[big] = np.minimum(1 + some, c[big])
    return t


def expected(c: np.ndarray, weight: np.ndarray, d: float) -> np.ndarray:
    """The mean of what ``draw`` draws."""
    c, t = np.asarray(c, np.int64), np.ones(len(c))
    for k in np.unique(c[(c > 1) & (c <= EXACT)]).tolist():
        at = np.flatnonzero(c == k)
        t[at] = _chances(k, weight[at], d) @ np.arange(1, k + 1)
    big = np.flatnonzero(c > EXACT)
    t[big] = np.minimum(1 + _mean_beyond(c[big].astype(float), weight[big], d), c[big])
    return t
