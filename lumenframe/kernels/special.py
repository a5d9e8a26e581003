"""Special functions and distributions, vectorised."""

from __future__ import annotations

from math import erf as _erf
from math import erfc, exp, inf, lgamma, log, log1p, pi, sqrt

import numpy as np

erf = np.vectorize(_erf, otypes=[float])
erfc_all = np.vectorize(erfc, otypes=[float])
loggamma_real = np.vectorize(lgamma, otypes=[float])


def wofz(z: np.ndarray, n: int = 32) -> np.ndarray:
    """Faddeeva function by Weideman's rational expansion; the upper half plane directly, the lower by reflection."""
    z = np.asarray(z, complex)
    low = z.imag < 0
    up = np.where(low, np.conj(z), z)
    m = 2 * n
    k = np.arange(-m + 1, m)
    scale = sqrt(n / sqrt(2))
    t = scale * np.tan(k * pi / m / 2)
    f = np.concatenate([[0], np.exp(-t * t) * (scale * scale + t * t)])
    a = np.real(np.fft.fft(np.fft.fftshift(f))) / (2 * m)
    a = a[1 : n + 1][::-1]
    ratio = (scale + 1j * up) / (scale - 1j * up)
    w = 2 * np.polyval(a, ratio) / (scale - 1j * up) ** 2 + (1 / sqrt(pi)) / (scale - 1j * up)
    return np.where(low, 2 * np.exp(-z * z) - np.conj(w), w)


def log_gamma(z: np.ndarray) -> np.ndarray:
    """Complex log gamma for a positive real part: recurrence up to 8, then Stirling's series."""
    z = np.asarray(z, complex)
    shift = np.zeros_like(z)
    w = z.copy()
    for _ in range(8):
        shift += np.log(w)
        w = w + 1
    inv = 1 / w
    series = inv / 12 - inv**3 / 360 + inv**5 / 1260 - inv**7 / 1680
    return (w - 0.5) * np.log(w) - w + 0.5 * log(2 * pi) + series - shift


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = exp(a * log(x) + b * log1p(-x) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(v := 1 - (a + b) * x / (a + 1)), tiny) * (1 if v >= 0 else -1)
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (v if abs(v := 1 + num * d) > tiny else tiny)
            c = v if abs(v := 1 + num / c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def f_sf(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    return beta_cdf(df2 / (df2 + df1 * f), df2 / 2, df1 / 2) if f > 0 else 1.0


def normal_sf(z: float) -> float:
    return 0.5 * erfc(z / sqrt(2))


def normal_ppf(p: float) -> float:
    """Quantile by Newton steps on the tail function."""
    if p <= 0 or p >= 1:
        return -inf if p <= 0 else inf
    z = 0.0
    for _ in range(60):
        step = (1 - normal_sf(z) - p) * sqrt(2 * pi) * exp(min(z * z / 2, 60))
        z -= max(-1.0, min(1.0, step))
        if abs(step) < 1e-13:
            break
    return z


def mann_whitney_p(u: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided; exact when a sample has 8 at most and nothing is tied, else normal with corrections."""
    big = max(u, n1 * n2 - u)
    if ties == 0 and min(n1, n2) <= 8:
        counts = np.zeros(n1 * n2 + 1)
        counts[0] = 1
        for j in range(1, n1 + 1):  # Gaussian binomial: multiply (1 - q^(n2+j)) and divide (1 - q^j)
            counts[n2 + j :] -= counts[: len(counts) - n2 - j].copy() if n2 + j < len(counts) else 0
            for k in range(j, len(counts)):
                counts[k] += counts[k - j]
        return float(min(1.0, 2 * counts[int(np.ceil(big)) :].sum() / counts.sum()))
    n = n1 + n2
    s = sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    return min(1.0, 2 * normal_sf((big - n1 * n2 / 2 - 0.5) / s)) if s else 1.0


def normal_scores(rank: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Expected places of the ranks 1 to n among n normal values (Blom): the steps of normal_ppf for all at once."""
    p = (np.asarray(rank, float) - 0.375) / (np.asarray(n, float) + 0.25)
    z = np.zeros_like(p)
    for _ in range(60 if p.size else 0):
        step = (1 - 0.5 * erfc_all(z / sqrt(2)) - p) * sqrt(2 * pi) * np.exp(np.minimum(z * z / 2, 60))
        z -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-12:
            break
    return z


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """(W, p) by Royston's approximation (AS R94)."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 3:
        return 1.0, 1.0
    m, d = normal_scores(np.arange(1, n + 1), n), x - x.mean()
    return shapiro_wilk_of_sums(n, float(m @ d), float(m @ m), float(d @ d), (d[0], d[1], d[-2], d[-1]))


def shapiro_wilk_of_sums(n: int, mx: float, mm: float, xx: float, ends: tuple[float, float, float, float]) -> tuple[float, float]:
    """The same from sums: normal scores by centred values, their squares, squares of the values, and the two values at each end."""
    if n < 3 or ends[0] == ends[3]:
        return 1.0, 1.0
    c, m, u = {}, {}, 1 / sqrt(n)
    for back in (1, 2):
        m[back] = normal_ppf((n + 1 - back - 0.375) / (n + 0.25))
        c[back] = m[back] / sqrt(mm)
    if n == 3:
        ax = sqrt(0.5) * (ends[3] - ends[0])
    else:
        # Royston's polynomials.
        a = {1: np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, c[1]], u)}
        if n > 5:
            a[2] = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[2]], u)
        phi = (mm - 2 * sum(m[k] ** 2 for k in a)) / (1 - 2 * sum(v**2 for v in a.values()))
        spread = {1: ends[3] - ends[0], 2: ends[2] - ends[1]}
        ax = (mx - sum(m[k] * spread[k] for k in a)) / sqrt(phi) + sum(v * spread[k] for k, v in a.items())
    w = min(float(ax**2 / xx), 1.0)
    if n == 3:
        return w, max(0.0, min(1.0, 6 / pi * (np.arcsin(sqrt(w)) - np.arcsin(sqrt(0.75)))))
    y = log(max(1 - w, 1e-300))
    if n <= 11:
        g = -2.273 + 0.459 * n
        if g - y <= 0:
            return w, 0.0
        y, mu, s = -log(g - y), np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        ln = log(n)
        mu, s = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, normal_sf((y - mu) / s)
