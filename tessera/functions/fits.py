"""Maximum-likelihood estimates from sums and from weighted points (numpy, on the driver).

A box of values is represented by its power sums of the local coordinate
``z`` in [-1, 1]; ``box_points`` turns them into ``DEGREE`` weighted points
that integrate every polynomial of lower degree exactly, so the sum of a
smooth function over all rows is a weighted sum over the points.
"""

from __future__ import annotations

import math

import numpy as np

from tessera.functions import special as S

#: Points of a box; its power sums go from 0 to one less.
DEGREE = 8
_NODES = np.cos((2 * np.arange(DEGREE) + 1) * np.pi / (2 * DEGREE))
_TO_WEIGHTS = np.linalg.inv(np.vander(_NODES, increasing=True).T)


def box_points(centre, half, sums) -> tuple[np.ndarray, np.ndarray]:
    """(positions, weights) of boxes given by centre, half width and power sums (boxes x DEGREE)."""
    w = np.asarray(sums, float) @ _TO_WEIGHTS.T
    x = np.asarray(centre, float)[:, None] + np.asarray(half, float)[:, None] * _NODES
    return x.ravel(), w.ravel()


def gamma_params(mean: float, mean_log: float) -> list[float]:
    """(shape, scale): Newton steps on the digamma equation."""
    s = math.log(mean) - mean_log
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        k_new = k - (math.log(k) - S.digamma(k) - s) / (1 / k - S.trigamma(k))
        if abs(k_new - k) < 1e-12:
            k = k_new
            break
        k = k_new
    return [k, mean / k]


def beta_params(mean: float, var: float, mean_log: float, mean_log1: float) -> list[float]:
    """(alpha, beta) of values in (0, 1): Newton steps from the estimates by moments."""
    common = mean * (1 - mean) / var - 1
    al, be = max(mean * common, 1e-3), max((1 - mean) * common, 1e-3)
    for _ in range(100):
        g1 = S.digamma(al) - S.digamma(al + be) - mean_log
        g2 = S.digamma(be) - S.digamma(al + be) - mean_log1
        t0 = S.trigamma(al + be)
        j11, j12, j22 = S.trigamma(al) - t0, -t0, S.trigamma(be) - t0
        det = j11 * j22 - j12 * j12
        da, db = (g1 * j22 - g2 * j12) / det, (j11 * g2 - j12 * g1) / det
        al, be = max(al - da, al / 2), max(be - db, be / 2)
        if abs(da) + abs(db) < 1e-12:
            break
    return [al, be]


def weibull_params(u: np.ndarray, w: np.ndarray, mean_log: float) -> list[float]:
    """(shape, scale) from points ``u`` = ln x: the shape's equation is increasing, so it is bisected."""
    top, n = u.max(), w.sum()

    def value(k):
        e = w * np.exp(k * (u - top))
        return (e @ u) / e.sum() - 1 / k - mean_log

    lo = hi = 1.0
    while value(lo) > 0:
        lo /= 2
    while value(hi) < 0:
        hi *= 2
    for _ in range(200):
        k = (lo + hi) / 2
        if k in (lo, hi):
            break
        lo, hi = (lo, k) if value(k) > 0 else (k, hi)
    return [k, math.exp(top + math.log((w @ np.exp(k * (u - top))) / n) / k)]


#: Degrees of freedom searched by ``t_params``; data without heavy tails end at the upper bound.
T_RANGE = (0.05, 1e4)


def t_params(x: np.ndarray, w: np.ndarray, mu: float, sigma: float) -> list[float]:
    """(degrees of freedom, location, scale): the likelihood at its best location and scale, searched over the degrees."""
    n, least = w.sum(), 1e-8 * sigma

    def profile(log_nu, mu, sigma):
        """(log-likelihood, location, scale); a scale that vanishes on equal values counts as no fit."""
        nu, start = math.exp(log_nu), (mu, sigma)
        for _ in range(1000):
            g = w * (nu + 1) / (nu + ((x - mu) / sigma) ** 2)
            m = (g @ x) / g.sum()
            s = math.sqrt((g @ (x - m) ** 2) / g.sum())
            done = abs(m - mu) + abs(s - sigma) <= 1e-13 * (s + abs(m))
            if s < least:
                return -math.inf, *start
            mu, sigma = m, s
            if done:
                break
        like = (n * (math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - math.log(sigma))
                - (nu + 1) / 2 * (w @ np.log1p(((x - mu) / sigma) ** 2 / nu)))
        return like, mu, sigma

    grid = np.linspace(math.log(T_RANGE[1]), math.log(T_RANGE[0]), 37)
    found = []
    for g in grid:
        like, mu, sigma = profile(g, mu, sigma)
        found.append((like, g, mu, sigma))
    best = max(range(len(found)), key=lambda i: found[i][0])
    _, at, mu, sigma = found[best]
    lo, hi = grid[min(best + 1, len(grid) - 1)], grid[max(best - 1, 0)]
    ratio = (math.sqrt(5) - 1) / 2
    a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    fa, fb = profile(a, mu, sigma)[0], profile(b, mu, sigma)[0]
    while hi - lo > 1e-8:
        if fa > fb:
            hi, b, fb = b, a, fa
            a = hi - ratio * (hi - lo)
            fa = profile(a, mu, sigma)[0]
        else:
            lo, a, fa = a, b, fb
            b = lo + ratio * (hi - lo)
            fb = profile(b, mu, sigma)[0]
    at = (lo + hi) / 2
    _, mu, sigma = profile(at, mu, sigma)
    return [math.exp(at), mu, sigma]
