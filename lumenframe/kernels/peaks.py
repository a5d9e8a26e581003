"""Peak shapes, bounded least squares, peak guessing, clustering and despiking of one spectrum."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from lumenframe.kernels import linalg as L
from lumenframe.kernels import special

LN2 = np.log(2.0)


def _width(x, x0, dx, dx_left):
    return np.where(x < x0, dx_left, dx)


def gaussian(x, a, x0, dx):
    return a * np.exp(-LN2 * ((x - x0) / dx) ** 2)


def lorentzian(x, a, x0, dx):
    return a / (1 + ((x - x0) / dx) ** 2)


def skewed_gaussian(x, a, x0, dx, gamma):
    s = dx / np.sqrt(2 * LN2)
    return gaussian(x, a, x0, dx) * (1 + special.erf(gamma * (x - x0) / (s * np.sqrt(2))))


def voigt(x, a, x0, dx, gamma):
    """Height a at x0; dx is the Gaussian part's half width, gamma the Lorentzian part's."""
    s = np.maximum(dx, 1e-9) / np.sqrt(2 * LN2)
    top = special.wofz(1j * gamma / (s * np.sqrt(2))).real
    return a * special.wofz((x - x0 + 1j * gamma) / (s * np.sqrt(2))).real / top


def skewed_voigt(x, a, x0, dx, gamma, skew):
    s = dx / np.sqrt(2 * LN2)
    return voigt(x, a, x0, dx, gamma) * (1 + special.erf(skew * (x - x0) / (s * np.sqrt(2))))


def pseudo_voigt(x, a, x0, dx, l_ratio):
    if not np.all((np.asarray(l_ratio) >= 0) & (np.asarray(l_ratio) <= 1)):
        raise ValueError("l_ratio must lie in [0, 1]")
    return l_ratio * lorentzian(x, a, x0, dx) + (1 - l_ratio) * gaussian(x, a, x0, dx)


def pearson7(x, a, x0, dx, expon):
    m = np.where(np.asarray(expon) == 0, 0.1, expon)
    return a * (1 + ((x - x0) / dx) ** 2 * (2 ** (1 / m) - 1)) ** -m


def pearson4(x, a, x0, dx, expon, skew):
    """Pearson IV with width dx; a scales the normalised density to about the height."""
    m = np.maximum(expon, 0.51)
    u = (x - x0) / dx
    log_norm = 2 * (special.log_gamma(m + 0.5j * skew).real - special.log_gamma(np.asarray(m, complex)).real)
    return a * np.exp(log_norm - m * np.log1p(u * u) - skew * np.arctan(u))


def _split(shape: Callable) -> Callable:
    def halves(x, a, x0, dx, dx_left, *rest):
        left, right = shape(x, a, x0, dx_left, *rest), shape(x, a, x0, dx, *rest)
        return np.where(x < x0, left, right)

    return halves


@dataclass(frozen=True)
class Shape:
    f: Callable
    extra: tuple[str, ...]


SHAPES = {
    "Gaussian": Shape(gaussian, ()), "Split Gaussian": Shape(_split(gaussian), ("dx_left",)), "Skewed Gaussian": Shape(skewed_gaussian, ("gamma",)),
    "Lorentzian": Shape(lorentzian, ()), "Split Lorentzian": Shape(_split(lorentzian), ("dx_left",)),
    "Voigt": Shape(voigt, ("gamma",)), "Split Voigt": Shape(_split(voigt), ("dx_left", "gamma")), "Skewed Voigt": Shape(skewed_voigt, ("gamma", "skew")),
    "Pseudo Voigt": Shape(pseudo_voigt, ("l_ratio",)), "Split Pseudo Voigt": Shape(_split(pseudo_voigt), ("dx_left", "l_ratio")),
    "Pearson4": Shape(pearson4, ("expon", "skew")), "Split Pearson4": Shape(_split(pearson4), ("dx_left", "expon", "skew")),
    "Pearson7": Shape(pearson7, ("expon",)), "Split Pearson7": Shape(_split(pearson7), ("dx_left", "expon")),
}
#: Start and bounds of the further parameters; None: half and twice the line's dx.
EXTRA = {"dx_left": None, "gamma": (0.5, 0.0, 50.0), "skew": (0.0, -10.0, 10.0), "l_ratio": (0.6, 0.0, 1.0), "expon": (1.0, 0.55, 100.0)}


@dataclass
class Fit:
    values: np.ndarray
    errors: np.ndarray
    covariance: np.ndarray
    curve: np.ndarray
    jacobian: np.ndarray
    chisqr: float
    redchi: float
    aic: float
    bic: float
    r2: float


def least_squares(f: Callable, start: np.ndarray, low: np.ndarray, high: np.ndarray, y: np.ndarray, weight: Callable | None = None, max_iter: int = 100, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Projected Levenberg-Marquardt. weight(residual): factors on residuals, renewed each round. Returns (values, Jacobian)."""
    p, damp = np.clip(start.astype(float), low, high), 1e-2
    curve = f(p)
    w = np.ones(len(y)) if weight is None else weight(y - curve)
    cost = ((w * (y - curve)) ** 2).sum()
    jac = np.zeros((len(y), len(p)))
    for _ in range(max_iter):
        for k in range(len(p)):
            h = 1e-6 * max(abs(p[k]), 1e-3)
            q = p.copy()
            q[k] = p[k] + h if p[k] + h <= high[k] else p[k] - h
            jac[:, k] = (f(q) - curve) / (q[k] - p[k])
        jw = jac * w[:, None]
        g, a = jw.T @ (w * (y - curve)), jw.T @ jw
        free = ~(((p <= low) & (g < 0)) | ((p >= high) & (g > 0)))
        better = False
        for _ in range(12):
            step = np.zeros(len(p))
            m = a[np.ix_(free, free)]
            if free.any():
                step[free] = np.linalg.lstsq(m + damp * np.diag(np.maximum(np.diag(m), 1e-12)), g[free], rcond=None)[0]
            q = np.clip(p + step, low, high)
            new_curve = f(q)
            new = ((w * (y - new_curve)) ** 2).sum()
            if np.isfinite(new) and new < cost:
                better = True
                break
            damp *= 4
        if not better:
            break
        small = cost - new < tol * cost and np.linalg.norm(q - p) < 1e-6 * (np.linalg.norm(p) + 1e-6)
        p, curve, damp = q, new_curve, max(damp / 5, 1e-12)
        w = w if weight is None else weight(y - curve)
        cost = ((w * (y - curve)) ** 2).sum()
        if small or cost < 1e-28:
            break
    return p, jac


def names(shape: str) -> tuple[str, ...]:
    return ("a", "x0", "dx", *SHAPES[shape].extra)


def model(x: np.ndarray, shapes: list[str]) -> Callable:
    sizes = [len(names(s)) for s in shapes]
    cuts = np.cumsum([0, *sizes])

    def f(p):
        return sum((SHAPES[s].f(x, *p[cuts[k] : cuts[k + 1]]) for k, s in enumerate(shapes)), np.zeros(len(x)))

    return f


def fit(x: np.ndarray, y: np.ndarray, shapes: list[str], start, low, high, max_iter: int = 100, solver: Callable = least_squares) -> Fit:
    """solver: called as least_squares is, without its weight and tol."""
    f = model(x, shapes)
    p, jac = solver(f, np.asarray(start, float), np.asarray(low, float), np.asarray(high, float), y, max_iter=max_iter)
    curve = f(p)
    n, k = len(y), len(p)
    chi = max(float(((y - curve) ** 2).sum()), 1e-250 * n)
    red = chi / max(1, n - k)
    cov = np.linalg.pinv(jac.T @ jac) * red
    log_like = n * np.log(chi / n)
    spread = float(((y - y.mean()) ** 2).sum())
    return Fit(p, np.sqrt(np.maximum(np.diag(cov), 0)), cov, curve, jac, chi, red, log_like + 2 * k, log_like + np.log(n) * k, 1 - chi / spread if spread else 0.0)


def models(x: np.ndarray, shapes: list[str]) -> Callable:
    """model of many rows of parameters: a curve each."""
    f = model(x, shapes)
    return lambda p: f(np.asarray(p).T[:, :, None])


def fit_many(x: np.ndarray, y: np.ndarray, shapes: list[str], start: np.ndarray, low: np.ndarray, high: np.ndarray, solver: Callable, max_iter: int = 100) -> list[Fit]:
    """fit of each row of y, all on one axis; solver takes and gives rows."""
    f = models(x, shapes)
    p, jac = solver(f, start, low, high, y, max_iter=max_iter)
    curve = f(p)
    n, k = len(x), p.shape[1]
    chi = np.maximum(((y - curve) ** 2).sum(axis=1), 1e-250 * n)
    red = chi / max(1, n - k)
    cov = np.linalg.pinv(jac.transpose(0, 2, 1) @ jac) * red[:, None, None]
    errors = np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0))
    log_like = n * np.log(chi / n)
    spread = ((y - y.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
    r2 = np.where(spread > 0, 1 - chi / np.where(spread > 0, spread, 1), 0.0)
    return [Fit(p[i], errors[i], cov[i], curve[i], jac[i], float(chi[i]), float(red[i]), float(log_like[i] + 2 * k), float(log_like[i] + np.log(n) * k), float(r2[i])) for i in range(len(y))]


def band(result: Fit, sigma: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower ends of the uncertainty band, by the delta method."""
    width = sigma * np.sqrt(np.maximum(((result.jacobian @ result.covariance) * result.jacobian).sum(axis=1), 0))
    return result.curve + width, result.curve - width


def line_bounds(shape: str, x0: float, a: float, fwhm: float, top: float) -> tuple[list[float], list[float], list[float]]:
    """(start, low, high) of one line: height to the maximum, place within a quarter width (moved up by one), half width to the width."""
    start, low, high = [a, x0, fwhm / 2], [0.0, x0 - fwhm / 4 + 1 if fwhm >= 4 else x0 - fwhm / 2, fwhm / 4], [max(top, a), x0 + fwhm / 4 + 1, fwhm]
    for e in SHAPES[shape].extra:
        s, lo, hi = EXTRA[e] or (fwhm / 2, fwhm / 4, fwhm)
        start.append(s)
        low.append(lo)
        high.append(hi)
    start[1] = min(max(start[1], low[1]), high[1])
    return start, low, high


def guess(x: np.ndarray, y: np.ndarray, shape: str = "Gaussian", fwhm: float | None = None, noise: float | None = None, most: int | None = None) -> tuple[list[float], Fit | None]:
    """Lines are added at the residual's maximum until it falls under the noise level or there are as many as the range holds."""
    step = np.median(np.diff(x)) if len(x) > 1 else 1.0
    fwhm = fwhm or 6 * step
    noise = noise if noise is not None else 3 * np.std(np.diff(y)) / np.sqrt(2)
    most = most or int(4 * (x[-1] - x[0]) / fwhm) + 1
    start: list[float] = []
    low: list[float] = []
    high: list[float] = []
    best: Fit | None = None
    residual = y.astype(float)
    for _ in range(most):
        k = int(np.argmax(residual))
        if residual[k] < noise:
            break
        s, lo, hi = line_bounds(shape, float(x[k]), float(residual[k]), fwhm, float(y.max()))
        start, low, high = [*start, *s], [*low, *lo], [*high, *hi]
        best = fit(x, y, [shape] * (len(start) // len(s)), start, low, high, 30)
        start = best.values.tolist()
        residual = y - best.curve
        residual[max(0, k - 1) : k + 2] = np.minimum(residual[max(0, k - 1) : k + 2], noise * 0.999) if residual[k] >= noise else residual[max(0, k - 1) : k + 2]
    width = len(names(shape))
    return sorted(start[1::width]), best


def split_by_borders(x: np.ndarray, borders: list[float]) -> list[slice]:
    """Half-open intervals between the borders inside the axis; the whole axis without any."""
    inside = [float(b) for b in sorted(borders) if x[0] < b < x[-1]]
    cuts = [0, *(int(np.argmin(np.abs(x - b))) for b in inside), len(x)]
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def half_widths(y: np.ndarray, k: int) -> tuple[float, float]:
    """Distance in points, to both sides, to half of the height at k, between points by straight lines."""
    half = y[k] / 2
    out = []
    for side in (y[k::-1], y[k:]):
        below = np.flatnonzero(side <= half)
        if not len(below):
            out.append(float(len(side) - 1))
            continue
        j = below[0]
        out.append(j - (half - side[j]) / max(side[j - 1] - side[j], 1e-300) if j else 0.0)
    return out[0], out[1]


def laser_fwhm(x: np.ndarray, y: np.ndarray, k: int, window: float) -> float:
    """Full width of the line at k, by its prominence within the window around it; five decimals."""
    inside = np.abs(x - x[k]) <= window
    if inside.sum() < 3:
        return 0.0
    part = y[inside]
    c = int(np.argmax(part))
    base = max(part[: c + 1].min(), part[c:].min())
    left, right = half_widths(part - base, c)
    span = x[inside]
    return round(float((left + right) * (span[-1] - span[0]) / len(part)), 5)


def cluster_places(groups: list[np.ndarray], hwhm: float, seed: int) -> list[float]:
    """Line places of many spectra of one interval to common centres.

    Values join the nearest cluster within hwhm of its median, else start one; the order is seeded.
    The most frequent number of lines decides how many of the fullest clusters stay.
    """
    rng = np.random.default_rng(seed)
    clusters: list[list[float]] = []
    for g in rng.permutation(len(groups)):
        for v in groups[g]:
            d = [abs(np.median(c) - v) for c in clusters]
            if d and min(d) <= hwhm:
                clusters[int(np.argmin(d))].append(float(v))
            else:
                clusters.append([float(v)])
    sizes, counts = np.unique([len(g) for g in groups], return_counts=True)
    wanted = int(sizes[np.argmax(counts)])
    fullest = sorted(clusters, key=len, reverse=True)[:wanted]
    return sorted(float(np.median(c)) for c in fullest)


def cluster_counts(places: np.ndarray, counts: np.ndarray, hwhm: float, wanted: int, seed: int) -> list[float]:
    """The same for places that are counted already: the most frequent place goes first, equal ones in a seeded order."""
    mixed = np.random.default_rng(seed).permutation(len(places))
    clusters: list[list[int]] = []
    centres: list[float] = []
    for i in np.lexsort((mixed, -counts)):
        d = np.abs(np.array(centres) - places[i])
        k = int(np.argmin(d)) if len(d) and d.min() <= hwhm else len(clusters)
        if k == len(clusters):
            clusters.append([])
            centres.append(0.0)
        clusters[k].append(int(i))
        own = np.array(sorted(clusters[k], key=lambda j: places[j]))
        below = np.cumsum(counts[own])
        centres[k] = float(np.mean([places[own[np.searchsorted(below, r, side="right")]] for r in ((below[-1] - 1) // 2, below[-1] // 2)]))
    fullest = sorted(range(len(clusters)), key=lambda k: counts[clusters[k]].sum(), reverse=True)[:wanted]
    return sorted(centres[k] for k in fullest)


def _spike(x, p):
    """Asymmetric pseudo-Voigt on a line: height, place, two half widths, Lorentz share, slope, offset."""
    a, x0, left, right, share, slope, offset = p
    return pseudo_voigt(x, a, x0, np.where(x < x0, left, right), min(max(share, 0.0), 1.0)) + slope * (x - x0) + offset


def despike(x: np.ndarray, y: np.ndarray, laser: float, fwhm: float, maxima: int = 3, width: float = 0.0, loops: int = 5) -> tuple[np.ndarray, list[float]]:
    """Cosmic spikes: narrow maxima of what a mollifier takes away, fitted and subtracted if no wider than `width`.

    Ignores what lies below laser + 5. Ends early when a maximum comes again or nothing narrow is left.
    """
    width = width or fwhm
    out, found, seen = y.astype(float).copy(), [], set()
    first = int(np.searchsorted(x, laser + 5))
    step = np.median(np.diff(x)) if len(x) > 1 else 1.0
    reach = max(3, int(np.ceil(2 * width / max(step, 1e-12))))
    for _ in range(loops):
        rest = out - L.moving_mean(out, reach)
        rest[:first] = -np.inf
        noise = 1.4826 * np.median(np.abs(rest[first:] - np.median(rest[first:]))) if len(rest) > first else 0
        hit = again = False
        for _ in range(maxima):
            k = int(np.argmax(rest))
            if not np.isfinite(rest[k]) or rest[k] < 6 * max(noise, 1e-12):
                break
            around = slice(max(first, k - reach), k + reach + 1)
            rest[around] = -np.inf
            if k in seen:
                again = True
                continue
            seen.add(k)
            xs, ys = x[around], out[around]
            if len(xs) < 8:
                continue
            start = np.array([out[k] - np.median(ys), x[k], width / 3, width / 3, 0.5, 0.0, np.median(ys)])
            low = np.array([0, x[k] - step, step / 4, step / 4, 0, -np.inf, -np.inf])
            high = np.array([np.ptp(ys) * 2, x[k] + step, 4 * width, 4 * width, 1, np.inf, np.inf])
            p, _ = least_squares(lambda q, u=xs: _spike(u, q), start, low, high, ys, lambda r: np.where(r < 0, 1.5, 1.0), 40)
            if p[2] + p[3] <= width:
                out[around] -= _spike(xs, np.array([*p[:5], 0.0, 0.0]))
                found.append(round(float(p[1]), 5))
                hit = True
        if again or not hit:
            break
    return out, found
