"""Scalar special functions for p-values and fits (no scipy).

Used on the driver only *after* Spark has reduced the data to a handful of
numbers, and (vectorised with numpy) inside Arrow batches for per-row CDFs.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_N = NormalDist()


def norm_cdf(x: float) -> float:
    return _N.cdf(x)


def norm_ppf(p: float) -> float:
    return _N.inv_cdf(p)


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))


# -- incomplete beta / gamma (continued fractions, Lentz) -------------------------------------
def _betacf(a: float, b: float, x: float, itmax: int = 400, eps: float = 1e-15) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, itmax + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    bt = math.exp(lbt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, 1.0 - x) / b


def gammainc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma P(a, x)."""
    if x <= 0:
        return 0.0
    gln = math.lgamma(a)
    if x < a + 1.0:
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(1000):
            ap += 1.0
            d *= x / ap
            s += d
            if abs(d) < abs(s) * 1e-16:
                break
        return s * math.exp(-x + a * math.log(x) - gln)
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < 1e-16:
            break
    return 1.0 - math.exp(-x + a * math.log(x) - gln) * h


# -- distributions -------------------------------------------------------------------------------
def t_sf(t: float, df: float) -> float:
    """P(T > t) for Student t."""
    x = df / (df + t * t)
    tail = 0.5 * betainc(df / 2.0, 0.5, x)
    return tail if t >= 0 else 1.0 - tail


def t_two_sided(t: float, df: float) -> float:
    return min(1.0, 2.0 * t_sf(abs(t), df))


def t_ppf(p: float, df: float) -> float:
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        if 1.0 - t_sf(mid, df) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def f_sf(f: float, d1: float, d2: float) -> float:
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_sf(x: float, k: float) -> float:
    if x <= 0:
        return 1.0
    return 1.0 - gammainc(k / 2.0, x / 2.0)


def kolmogorov_sf(d: float, n: int) -> float:
    """Asymptotic p-value of the one-sample KS statistic (Stephens' small-n correction)."""
    if n <= 0:
        return float("nan")
    en = math.sqrt(n)
    lam = (en + 0.12 + 0.11 / en) * d
    if lam < 1e-3:
        return 1.0
    s = 0.0
    for j in range(1, 101):
        term = 2.0 * (-1) ** (j - 1) * math.exp(-2.0 * j * j * lam * lam)
        s += term
        if abs(term) < 1e-12:
            break
    return max(0.0, min(1.0, s))


# -- studentised range (Tukey HSD) ----------------------------------------------------------------
_GL_X, _GL_W = np.polynomial.legendre.leggauss(64)


def _range_cdf_inf(q: float, k: int) -> float:
    """P(range of k std normals < q) by Gauss-Legendre on [-8, 8]."""
    if q <= 0:
        return 0.0
    z = 8.0 * _GL_X
    phi = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    cdf = np.array([norm_cdf(v) for v in z])
    cdf_q = np.array([norm_cdf(v - q) for v in z])
    inner = k * phi * np.clip(cdf - cdf_q, 0.0, 1.0) ** (k - 1)
    return float(8.0 * np.sum(_GL_W * inner))


def ptukey(q: float, k: int, df: float) -> float:
    """CDF of the studentised range with k groups and df degrees of freedom."""
    if df > 5000:
        return _range_cdf_inf(q, k)
    # integrate over s = chi / sqrt(df): density of s
    lo, hi = max(1e-6, 1 - 8 / math.sqrt(2 * df)), 1 + 8 / math.sqrt(2 * df)
    xs = (hi - lo) / 2 * _GL_X + (hi + lo) / 2
    ws = (hi - lo) / 2 * _GL_W
    logc = math.log(df) * (df / 2) - math.lgamma(df / 2) - (df / 2 - 1) * math.log(2)
    tot = 0.0
    for s, w in zip(xs, ws):
        dens = math.exp(logc + (df - 1) * math.log(s) - df * s * s / 2)
        tot += w * dens * _range_cdf_inf(q * s, k)
    return float(min(1.0, max(0.0, tot)))


def qtukey(p: float, k: int, df: float) -> float:
    lo, hi = 0.0, 50.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if ptukey(mid, k, df) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


# -- vectorised CDFs for Arrow batches ---------------------------------------------------------------
def gammainc_vec(a: float, x: np.ndarray) -> np.ndarray:
    return np.array([gammainc(a, float(v)) if np.isfinite(v) else np.nan for v in x])


def betainc_vec(a: float, b: float, x: np.ndarray) -> np.ndarray:
    return np.array([betainc(a, b, float(v)) if np.isfinite(v) else np.nan for v in x])


def t_cdf_vec(t: np.ndarray, df: float) -> np.ndarray:
    return np.array([1.0 - t_sf(float(v), df) if np.isfinite(v) else np.nan for v in t])


def digamma(x: float) -> float:
    r = 0.0
    while x < 6:
        r -= 1 / x
        x += 1
    f = 1 / (x * x)
    return r + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def trigamma(x: float) -> float:
    r = 0.0
    while x < 6:
        r += 1 / (x * x)
        x += 1
    f = 1 / (x * x)
    return r + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


# -- Shapiro-Wilk (Royston 1992) --------------------------------------------------------------------
# fixed values: polynomial coefficients of Royston's approximation
SW_A_N = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
SW_A_N1 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SW_SMALL_GAMMA = [-2.273, 0.459]
SW_SMALL_MU = [0.5440, -0.39978, 0.025054, -6.714e-4]
SW_SMALL_SIGMA = [1.3822, -0.77857, 0.062767, -0.0020322]
SW_BIG_MU = [-1.5861, -0.31082, -0.083751, 0.0038915]
SW_BIG_SIGMA = [-0.4803, -0.082676, 0.0030302]


def _poly(cs, x):
    return sum(cf * x ** i for i, cf in enumerate(cs))


def shapiro_weights_tail(n: int, mm: float, m_n: float, m_n1: float) -> tuple[float, float, float]:
    """(a_n, a_(n-1), phi) for Royston's weights; middle weights are m_i / sqrt(phi)."""
    u = 1.0 / math.sqrt(n)
    a_n = m_n / math.sqrt(mm) + _poly(SW_A_N, u)
    if n > 5:
        a_n1 = m_n1 / math.sqrt(mm) + _poly(SW_A_N1, u)
        phi = (mm - 2 * m_n ** 2 - 2 * m_n1 ** 2) / (1 - 2 * a_n ** 2 - 2 * a_n1 ** 2)
    else:
        a_n1 = float("nan")
        phi = (mm - 2 * m_n ** 2) / (1 - 2 * a_n ** 2)
    return a_n, a_n1, phi


def shapiro_p(w: float, n: int) -> float:
    if n < 4 or not (0 < w < 1):
        return float("nan") if n < 4 else (1.0 if w >= 1 else 0.0)
    if n <= 11:
        gamma = _poly(SW_SMALL_GAMMA, n)
        mu = _poly(SW_SMALL_MU, n)
        sigma = math.exp(_poly(SW_SMALL_SIGMA, n))
        y = -math.log(gamma - math.log1p(-w))
    else:
        ln = math.log(n)
        mu = _poly(SW_BIG_MU, ln)
        sigma = math.exp(_poly(SW_BIG_SIGMA, ln))
        y = math.log1p(-w)
    return norm_sf((y - mu) / sigma)


# -- ADF (MacKinnon response surfaces, constant-only regression, one variable) ------------------------
# fixed values: MacKinnon (1994) p-value surface and (2010) critical values for regression "c"
ADF_TAU_MAX, ADF_TAU_MIN, ADF_TAU_STAR = 2.74, -18.83, -1.61
ADF_SMALLP = [2.1659, 1.4412, 0.038269]
ADF_LARGEP = [1.7339, 0.93202, -0.12745, -0.010368]
ADF_CRIT = {"1%": [-3.43035, -6.5393, -16.786, -79.433], "5%": [-2.86154, -2.8903, -4.234, -40.040],
            "10%": [-2.56677, -1.5384, -2.809, 0.0]}


def adf_pvalue(stat: float) -> float:
    if stat > ADF_TAU_MAX:
        return 1.0
    if stat < ADF_TAU_MIN:
        return 0.0
    cs = ADF_SMALLP if stat <= ADF_TAU_STAR else ADF_LARGEP
    return norm_cdf(_poly(cs, stat))


def adf_critical(nobs: int) -> dict[str, float]:
    return {k: v[0] + v[1] / nobs + v[2] / nobs ** 2 + v[3] / nobs ** 3 for k, v in ADF_CRIT.items()}


# -- inversion counting (Kendall) --------------------------------------------------------------------
def count_inversions(seq) -> int:
    """Pairs i < j with seq[i] > seq[j] (strict), by a vectorised bottom-up merge sort."""
    a = np.asarray(seq, dtype=np.int64)
    n = len(a)
    if n < 2:
        return 0
    a = a - a.min()
    m = int(a.max()) + 1
    total = 0
    s = 1
    idx = np.arange(n)
    while s < n:
        pair = idx // (2 * s)
        is_left = (idx % (2 * s)) < s
        left_keys = pair[is_left] * m + a[is_left]
        pr = pair[~is_left]
        le = np.searchsorted(left_keys, pr * m + a[~is_left], side="right")
        end = np.searchsorted(left_keys, pr * m + m, side="left")
        total += int(np.sum(end - le))
        a = a[np.lexsort((a, pair))]
        s *= 2
    return total


def discordant_pairs(x, y) -> int:
    """Pairs with x_i < x_j and y_i > y_j (ties in either are not discordant)."""
    x = np.asarray(x, dtype="float64")
    y = np.asarray(y, dtype="float64")
    order = np.lexsort((y, x))
    _, ry = np.unique(y[order], return_inverse=True)
    return count_inversions(ry)


def weighted_discordant(x, y, w) -> int:
    """Sum of w_i w_j over pairs with x_i < x_j and y_i > y_j (ties in either are not discordant).

    The values are sorted by (x, y); inversions of the y ranks are counted bit
    by bit: within equal higher bits, a 1 before a 0 is an inversion.
    """
    order = np.lexsort((y, x))
    _, r = np.unique(np.asarray(y, "float64")[order], return_inverse=True)
    w, total = np.asarray(w, "int64")[order], 0
    for b in range(int(r.max(initial=0)).bit_length() - 1, -1, -1):
        one = (r >> b) & 1
        ones = np.cumsum(w * one)
        start = np.concatenate(([0], np.flatnonzero(np.diff(r >> (b + 1))) + 1))
        before = np.concatenate(([0], ones))[start]
        zeros = one == 0
        total += int((w * (ones - np.repeat(before, np.diff(np.append(start, len(r))))))[zeros].sum())
        order = np.argsort(r >> b, kind="stable")
        r, w = r[order], w[order]
    return total
