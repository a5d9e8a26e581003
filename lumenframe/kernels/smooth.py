"""Smoothers of one spectrum that array expressions can't state, and the scatter correction EMSC."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from lumenframe.kernels import linalg as L
from lumenframe.kernels import signal


def whittaker(x, y, lam=1.0):
    return L.whittaker(y, np.ones(len(y)), lam)


def _extrema(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the maxima and minima of each row."""
    d = np.sign(np.diff(y, axis=1))
    top, low = np.zeros(y.shape, bool), np.zeros(y.shape, bool)
    top[:, 1:-1], low[:, 1:-1] = (d[:, :-1] > 0) & (d[:, 1:] <= 0), (d[:, :-1] < 0) & (d[:, 1:] >= 0)
    return top, low


def _envelopes(at: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Akima's interpolation through the marked places of each row (one at least), two of them mirrored beyond each end: slopes weigh neighbouring chords by how little the far ones bend."""
    count, last = at.sum(axis=1), y.shape[1] - 1
    ends, rows = np.minimum(count, 2), np.arange(len(y))
    row, place = np.nonzero(at)
    rank = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    width = int(count.max()) + 4
    xk, yk = np.zeros((len(y), width)), np.zeros((len(y), width))
    for kept, knot, x in ((rank >= 0, ends[row] + rank, place), (rank < 2, ends[row] - 1 - rank, -place), (count[row] - 1 - rank < 2, ends[row] + 2 * count[row] - 1 - rank, 2 * last - place)):
        xk[row[kept], knot[kept]], yk[row[kept], knot[kept]] = x[kept], y[row, place][kept]
    chords = count + 2 * ends - 1
    beyond = np.arange(width) - chords[:, None]
    xk = np.where(beyond > 0, xk[rows, chords][:, None] + beyond, xk)  # knots of no row
    m = np.zeros((len(y), width + 3))
    m[:, 2:-2] = np.diff(yk, axis=1) / np.diff(xk, axis=1)
    m[:, 0], m[:, 1] = 3 * m[:, 2] - 2 * m[:, 3], 2 * m[:, 2] - m[:, 3]
    final, before = m[rows, chords + 1], m[rows, chords]
    m[rows, chords + 2], m[rows, chords + 3] = 2 * final - before, 3 * final - 2 * before
    d = np.abs(np.diff(m, axis=1))
    w1, w2 = d[:, 2:], d[:, :-2]
    s = np.where(w1 + w2 > 1e-12, (w1 * m[:, 1:-2] + w2 * m[:, 2:-1]) / np.maximum(w1 + w2, 1e-300), 0.5 * (m[:, 1:-2] + m[:, 2:-1]))
    k = ends[:, None] + np.cumsum(at, axis=1) - 1
    x0, y0, s0, x1, y1, s1 = (np.take_along_axis(v, k + j, axis=1) for j in (0, 1) for v in (xk, yk, s))
    h, u = x1 - x0, np.arange(last + 1.0) - x0
    c = (3 * (y1 - y0) / h - 2 * s0 - s1) / h
    e = (s0 + s1 - 2 * (y1 - y0) / h) / h**2
    return y0 + u * (s0 + u * (c + u * e))


def imfs(y: np.ndarray, sifts: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """The first intrinsic mode of each row, and which rows have one: those with extrema enough; others give zeros."""
    h, has = y.astype(float), np.zeros(len(y), bool)
    at = np.arange(len(y))
    for _ in range(sifts):
        top, low = _extrema(h[at])
        tops, lows = top.sum(axis=1), low.sum(axis=1)
        go = (tops + lows >= 4) & (tops > 0) & (lows > 0)
        at, top, low = at[go], top[go], low[go]
        if not len(at):
            break
        mid = 0.5 * (_envelopes(top, h[at]) + _envelopes(low, h[at]))
        new = h[at] - mid
        h[at], has[at] = new, True
        at = at[(mid * mid).sum(axis=1) >= 0.2e-3 * np.maximum((new * new).sum(axis=1), 1e-300)]
    return np.where(has[:, None], h, 0.0), has


def emd_modes(y: np.ndarray, most: int = 10) -> list[np.ndarray]:
    """The first modes of each row; zeros where a row has no more."""
    out, rest, has = [], y.astype(float), np.ones(len(y), bool)
    while len(out) < most and has.any():
        mode = np.zeros(rest.shape)
        mode[has], more = imfs(rest[has])
        has[has] = more
        if has.any():
            out.append(mode)
            rest = rest - mode
    return out


def emd_many(y: np.ndarray, seeds=(), noise_first_imfs=1) -> np.ndarray:
    """emd of each row."""
    return y - sum(emd_modes(y, noise_first_imfs), np.zeros(y.shape))


def emd(x, y, noise_first_imfs=1):
    """Without the first modes."""
    return emd_many(y[None], (), noise_first_imfs)[0]


def eemd_many(y: np.ndarray, seeds, noise_first_imfs=1, trials=20, width=0.05) -> np.ndarray:
    """eemd of each row with its seed."""
    devs = width * np.maximum(np.ptp(y, axis=1), 1e-12)
    noisy = np.concatenate([v + np.random.default_rng(seed).uniform(-dev, dev, (trials, len(v))) for v, dev, seed in zip(y, devs, seeds, strict=True)])
    gone = sum(emd_modes(noisy, noise_first_imfs), np.zeros(noisy.shape))
    return y - gone.reshape(len(y), trials, -1).sum(axis=1) / trials


def eemd(x, y, noise_first_imfs=1, trials=20, seed=0, width=0.05):
    """Modes averaged over trials with uniform noise."""
    return eemd_many(y[None], [seed], noise_first_imfs, trials, width)[0]


def ceemdan_many(y: np.ndarray, seeds, noise_first_imfs=1, trials=20, epsilon=0.005) -> np.ndarray:
    """ceemdan of each row with its seed."""
    noises = emd_modes(np.concatenate([np.random.default_rng(seed).standard_normal((trials, y.shape[1])) for seed in seeds]), noise_first_imfs + 1)
    rest = y.astype(float)
    for k in range(noise_first_imfs):
        size = np.repeat(epsilon * np.maximum([np.std(v) for v in rest], 1e-12), trials)
        first = imfs(np.repeat(rest, trials, axis=0) + size[:, None] * (noises[k] if k < len(noises) else 0.0))[0]
        rest = rest - first.reshape(len(y), trials, -1).sum(axis=1) / trials
    return rest


def ceemdan(x, y, noise_first_imfs=1, trials=20, seed=0, epsilon=0.005):
    """Each mode is the mean first mode of the remainder with adaptive noise modes added."""
    return ceemdan_many(y[None], [seed], noise_first_imfs, trials, epsilon)[0]


#: The least and the greatest number of rounds as polynomials of the signal-to-noise ratio, highest power first; above 200 they are constant.
LEAST_ROUNDS = (-0.00000000000020511637148964194179, 0.00000000017456738606819003079, -0.00000006108370350381461555, 0.000011326343084825261969, -0.001196766893248055099, 0.072278932710701945807, -2.3738144356931862866, 36.543962848162728108)
MOST_ROUNDS = (0.000000049662053296461794872, -0.000045735657830153646274, 0.013867582814278392803, -1.7581457324626106331, 88.680082559339525284)
ROUNDS_ABOVE_200 = (2, 5)


def _telling_peaks(x: np.ndarray, y: np.ndarray, distance: float | None) -> np.ndarray:
    """Places of peaks that stand out of the detrended data less their polynomial of degree 9; the place nearest to the greatest rest if none does.

    Peaks are one to five distances wide; without a distance, it is half the width of the highest.
    """
    places = np.arange(len(y))
    rest = y - L.polynomial(places.astype(float), y, 1)
    rest = rest - L.polynomial(x, rest, 9)
    height, spread = rest.max(), np.ptp(rest)
    if spread == 0:
        return np.zeros(1, np.int64)
    rest = (rest - rest.min()) / spread
    if distance is None:
        calm = L.savgol(rest, 9, 3)
        apart = max(1.0, signal.width_of(calm, int(calm.argmax())) / 2)
    else:
        apart = distance / ((x.max() - x.min()) / len(x))
    at = signal.find_peaks(rest, height=(1 - 2 * rest.std(), 1.0), distance=1.5 * apart, width=(apart, 5 * apart))
    return at if len(at) else np.array([np.abs(rest - height).argmin()])


def _rounds(x: np.ndarray, y: np.ndarray, at: np.ndarray, sigma: float, snr: float | None, gaussian: bool) -> np.ndarray:
    """Rounds by the distance of the nearest peak, along a bell: fewest on the peaks, most far off; the bell multiplies by the squared width if not gaussian."""
    if snr is None:
        rest = y - L.polynomial(np.arange(len(y), dtype=float), y, 1)
        snr = rest.max() / np.std(rest - L.savgol(rest, 9, 3))
    ends = ROUNDS_ABOVE_200 if snr > 200 else np.rint([np.polyval(LEAST_ROUNDS, snr), np.polyval(MOST_ROUNDS, snr)])
    peaks, wide = np.sort(x[at]), (sigma * (x[1] - x[0])) ** 2
    next_one = np.searchsorted(peaks, x)
    near = np.minimum(np.abs(x - peaks[np.maximum(next_one - 1, 0)]), np.abs(x - peaks[np.minimum(next_one, len(peaks) - 1)]))
    far = -np.expm1(-near * near / 2 * (1 / wide if gaussian else wide))
    return np.rint(np.interp(far, [0, 1], ends)).astype(int)


def _priors(first: int, last: int) -> list[tuple[int, int, float]]:
    """Window, order and weight of the Savitzky-Golay prior of each round: as long as every point takes part, then for the points left, and widening in the last fifth."""
    head = min(first, last)
    tail = min(round(last / 5), last - head)
    rounds = [(7, 5, 1.8)] * head + [(5, 3, 1.8)] * (last - head - tail)
    window, order, weight = rounds[-1] if rounds else (7, 5, 1.8)
    return rounds + [(window + 4 * k, order, weight * 10.0**k) for k in range(1, tail + 1)]


def likeliest(y: np.ndarray, prior: np.ndarray, weight: float, noise: float, power: float = 0.4) -> np.ndarray:
    """The t of least (y - t)^2 / (2 noise^2) + weight |t - prior|^power, exactly: the prior itself, or the place between it and y where the slopes meet."""
    d = np.abs(y - prior)
    pull = weight * power * noise * noise  # u + pull u^(power - 1) = d at distance u from the prior, if at all
    least = (pull * (1 - power)) ** (1 / (2 - power))
    meets = d > least + pull * least ** (power - 1)
    u = np.where(meets, d, 1.0)
    at = np.nonzero(meets)
    pull, least = np.broadcast_to(pull, d.shape), np.broadcast_to(least, d.shape)
    for _ in range(12):  # Newton from the right, over a convex function, for the points that still move
        v, k = u[at], pull[at]
        steep = k * v ** (power - 2)
        u[at] = np.maximum(v - (v + steep * v - d[at]) / (1 + (power - 1) * steep), least[at])
        moves = u[at] != v
        at = tuple(i[moves] for i in at)
        if not len(at[0]):
            break
    gain = d * d - (d - u) ** 2 - 2 * noise * noise * weight * u**power
    return np.where(meets & (gain > 0), prior + np.sign(y - prior) * u, prior)


def mlesg(x, y, distance=None, sigma=4.0, snr=None, gaussian=False):
    """Maximum likelihood of the signal under a Savitzky-Golay prior.

    In each round a point takes the value that costs least: its squared distance from the measured value,
    and a power of its distance from the smoothed estimates; it moves by three noise deviations at most.
    Points near peaks have fewer rounds.  In the last fifth of the rounds the windows widen and the prior
    weighs tenfold each time.  No window is wider than a tenth of the data (9 points at least), which
    matters below some 450 points only: there wider ones would smooth the peaks away.
    Fewer than 10 points, and data without noise, stay as they are.
    """
    y, n = np.asarray(y, float).copy(), len(y)
    if n < 10:
        return y
    noise = np.std(y - L.savgol(y, 9, 3))
    if not noise > 1e-12 * max(np.abs(y).max(), 1e-300):
        return y
    rounds = _rounds(x, y, _telling_peaks(x, y, distance), sigma, snr, gaussian)
    estimate, widest = y.copy(), max(9, n // 10 | 1)
    for j, (window, order, weight) in enumerate(_priors(rounds.min(), rounds.max())):
        aim = likeliest(y, L.savgol(estimate, min(window, widest), order), weight, noise)
        estimate = np.where(rounds > j, np.clip(aim, estimate - 3 * noise, estimate + 3 * noise), estimate)
    return estimate


def _savgol_many(y: np.ndarray, length: int, order: int) -> np.ndarray:
    """savgol of each row."""
    hat, half, n = L.window_projection(length, order), length // 2, y.shape[1]
    out = np.empty(y.shape)
    out[:, half : n - half] = np.lib.stride_tricks.sliding_window_view(y, length, axis=1) @ hat[half]
    out[:, :half] = y[:, :length] @ hat[:half].T
    out[:, n - half :] = y[:, n - length :] @ hat[half + 1 :].T
    return out


def mlesg_many(x, y, distance=None, sigma=4.0, snr=None, gaussian=False):
    """mlesg of each row of y, all on one axis. Only points that still have rounds are estimated."""
    y, n = np.asarray(y, float), y.shape[1]
    estimate = y.copy()
    if n < 10:
        return estimate
    noises, widest = np.std(y - _savgol_many(y, 9, 3), axis=1), max(9, n // 10 | 1)
    at = np.flatnonzero(noises > 1e-12 * np.maximum(np.abs(y).max(axis=1), 1e-300))
    rounds = np.zeros(y.shape, int)
    for i in at:
        rounds[i] = _rounds(x, y[i], _telling_peaks(x, y[i], distance), sigma, snr, gaussian)
    priors = {i: _priors(rounds[i].min(), rounds[i].max()) for i in at}
    for j in range(max(map(len, priors.values()), default=0)):
        alike: dict[tuple[int, int], list[int]] = {}
        for i in at:
            if j < len(priors[i]):
                alike.setdefault((min(priors[i][j][0], widest), priors[i][j][1]), []).append(i)
        new = estimate.copy()
        for (window, order), own in alike.items():
            row, place = np.nonzero(rounds[own] > j)
            prior = _savgol_many(estimate[own], window, order)[row, place]
            weight, row = np.array([priors[i][j][2] for i in own])[row], np.array(own)[row]
            old, noise = estimate[row, place], noises[row]
            aim = likeliest(y[row, place], prior, weight, noise)
            new[row, place] = np.clip(aim, old - 3 * noise, old + 3 * noise)
        estimate = new
    return estimate


SMOOTHERS = {"Whittaker": whittaker, "EMD": emd, "EEMD": eemd, "CEEMDAN": ceemdan, "MLESG": mlesg}
SEEDED = frozenset({"EEMD", "CEEMDAN"})
#: Those that take many spectra of one axis at once.
MANY_ON_AXIS = {"MLESG": mlesg_many}
#: Those that take many spectra of one length at once, with their seeds, and how many rows each makes of a spectrum by default.
MANY = {"EMD": (emd_many, 1), "EEMD": (eemd_many, 20), "CEEMDAN": (ceemdan_many, 20)}


@lru_cache(maxsize=4)
def _scatter_components(axis: bytes, n_pca: int) -> np.ndarray:
    """Principal components of Mie extinction curves over 150 sphere parameters (axis in 1/cm)."""
    x = np.frombuffer(axis)
    alpha = np.linspace(3.14, 49.95, 150) * 1e-4
    rho = alpha[:, None] * np.maximum(x[None, :], 1e-9)
    curves = 2 - 4 / rho * np.sin(rho) + 4 / rho**2 * (1 - np.cos(rho))
    return np.linalg.svd(curves - curves.mean(axis=0), full_matrices=False)[2][:n_pca]


def emsc(x, y, reference, n_pca=8):
    """Scale, offset and scatter removed; their fit is linear, so it is solved exactly."""
    p = _scatter_components(np.ascontiguousarray(x, float).tobytes(), n_pca)
    m = np.vstack([reference, np.ones(len(y)), p]).T
    c = np.linalg.lstsq(m, y, rcond=None)[0]
    return (y - m[:, 1:] @ c[1:]) / (c[0] if abs(c[0]) > 1e-12 else 1.0)
