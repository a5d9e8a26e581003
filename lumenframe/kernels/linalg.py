"""Small numerical tools that NumPy lacks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=64)
def penalty(n: int, order: int) -> np.ndarray:
    """D'D of the differences of an order, dense; spectra are some hundred to some thousand points."""
    d = np.diff(np.eye(n), order, axis=0) if n > order else np.zeros((1, n))
    out = d.T @ d
    out.setflags(write=False)
    return out


def whittaker(y: np.ndarray, w: np.ndarray, lam: float, order: int = 2) -> np.ndarray:
    """z that minimises sum w (y - z)^2 + lam * sum (difference of z)^2."""
    if len(y) <= order:
        return y.copy()
    q = _polynomials(np.arange(float(len(y))).tobytes(), order - 1)  # what the penalty leaves free, so the weights alone must hold it
    if np.linalg.eigvalsh((q * w[:, None]).T @ q)[0] >= 1e-11 * lam:
        return solve_banded(band_sum(difference_bands(len(y), order), lam, {0: w}), w * y)
    s = np.sqrt(w)  # weights that all but vanish beside lam: their square roots keep twice the digits
    rows = np.concatenate([np.sqrt(lam) * np.diff(np.eye(len(y)), order, axis=0), np.diag(s)])
    return np.linalg.lstsq(rows, np.concatenate([np.zeros(len(y) - order), s * y]), rcond=None)[0]


#: A banded matrix: offset o -> array of the values at (row, row + o), 0 where there is no such column.
Bands = dict[int, np.ndarray]


@lru_cache(maxsize=64)
def _difference_rows(n: int, order: int) -> tuple[np.ndarray, ...]:
    c = np.array([1.0])
    for _ in range(order):
        c = np.convolve(c, [1.0, -1.0])
    upper = [np.zeros(n) for _ in range(order + 1)]
    for k in range(order + 1):
        for i in range(order + 1 - k):
            upper[k][i : i + n - order] += c[i] * c[i + k]
    return tuple(upper)


def difference_bands(n: int, order: int) -> Bands:
    """D'D of the differences of an order."""
    upper = _difference_rows(n, order)
    return {o: upper[o] if o >= 0 else shifted(upper[-o], o) for o in range(-order, order + 1)}


def shifted(v: np.ndarray, o: int) -> np.ndarray:
    """v[row + o] in each row, 0 beyond the ends."""
    out, n = np.zeros_like(v), len(v)
    out[max(0, -o) : max(0, n - o)] = v[max(0, o) : max(0, n + o)]
    return out


def band_sum(a: Bands, scale, b: Bands) -> Bands:
    """scale * a + b; an array of scales multiplies the rows."""
    out = {o: scale * v for o, v in a.items()}
    for o, v in b.items():
        out[o] = out[o] + v if o in out else v
    return out


def band_product(a: Bands, b: Bands) -> Bands:
    out: Bands = {}
    for i, u in a.items():
        for j, v in b.items():
            term = u * shifted(v, i)
            out[i + j] = out[i + j] + term if i + j in out else term
    return out


def band_times(a: Bands, v: np.ndarray) -> np.ndarray:
    return sum(u * shifted(v, o) for o, u in a.items())


def solve_banded(bands: Bands, b: np.ndarray, size: int = 6) -> np.ndarray:
    """Solve a banded system, which needs no exchange of rows (positive definite, or rows of such a one scaled), by elimination of blocks."""
    n = len(b)
    size = max(size, *(abs(o) for o in bands))
    m = -(-n // size)
    row = np.arange(n)
    wide = np.zeros((m, size, 3 * size))
    wide.reshape(m * size, -1)[n:, :][:, size:] += np.eye(m * size - n, 2 * size, k=n - (m - 1) * size)  # rows beyond the last are those of 1
    for o, v in bands.items():
        at = row[max(0, -o) : max(0, n - max(0, o))]
        wide[at // size, at % size, size + at % size + o] += v[at]
    out = np.zeros(m * size)
    out[:n] = b
    out = out.reshape(m, size, 1)
    return _blocks(wide[:, :, :size], wide[:, :, size : 2 * size], wide[:, :, 2 * size :], out.reshape(m, size, 1)).ravel()[:n]


def solve_tridiagonal(side: float, mid: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each row's system with one value beside its diagonal, positive definite, by elimination from place to place of all rows at once."""
    n = mid.shape[1]
    mid, out = mid.T.copy(), b.T.copy()
    for i in range(1, n):
        f = side / mid[i - 1]
        mid[i] -= f * side
        out[i] -= f * out[i - 1]
    out[-1] /= mid[-1]
    for i in range(n - 2, -1, -1):
        out[i] = (out[i] - side * out[i + 1]) / mid[i]
    return out.T


def solve_banded_many(bands: Bands, b: np.ndarray) -> np.ndarray:
    """solve_banded of each row of b by the factors L D L' of symmetric systems, of all rows at once. bands: the upper ones, offset -> (rows, places)."""
    rows, n = b.shape
    reach = max(bands)
    upper = np.zeros((n + reach, reach + 1, rows))
    for o, v in bands.items():
        upper[: n - o, o] = np.broadcast_to(v, (rows, n)).T[: n - o]
    out = np.zeros((n + reach, rows))
    out[:n] = b.T
    for i in range(n):
        row = upper[i]
        f = row[1:] / row[0]
        out[i + 1 : i + 1 + reach] -= f * out[i]
        for k in range(min(reach, n - 1 - i)):
            upper[i + 1 + k, : reach - k] -= f[k] * row[1 + k :]
    for i in range(n - 1, -1, -1):
        out[i] = (out[i] - (upper[i, 1:] * out[i + 1 : i + 1 + reach]).sum(axis=0)) / upper[i, 0]
    return out[:n].T


def _blocks(left: np.ndarray, mid: np.ndarray, right: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cyclic reduction of block rows: every other one is put into its neighbours at a time."""
    m, size = mid.shape[:2]
    if m == 1:
        return np.linalg.solve(mid, b)
    gone = np.linalg.solve(mid[::2], np.concatenate([left[::2], right[::2], b[::2]], axis=2))
    beyond = gone[1:] if m % 2 else np.concatenate([gone[1:], np.zeros_like(gone[:1])])
    before, after = left[1::2] @ gone[: m // 2], right[1::2] @ beyond
    odd = _blocks(-before[:, :, :size], mid[1::2] - before[:, :, size : 2 * size] - after[:, :, :size], -after[:, :, size : 2 * size], b[1::2] - before[:, :, 2 * size :] - after[:, :, 2 * size :])
    z = np.empty_like(b)
    z[1::2] = odd
    even = gone[:, :, 2 * size :].copy()
    even[1:] -= gone[1:, :, :size] @ odd[: len(even) - 1]
    even[: m // 2] -= gone[: m // 2, :, size : 2 * size] @ odd
    z[::2] = even
    return z


@lru_cache(maxsize=16)
def _polynomials(axis: bytes, order: int) -> np.ndarray:
    """Orthonormal values of the polynomials up to an order on an axis, no more than it has places."""
    x = np.frombuffer(axis)
    span = x[-1] - x[0] if len(x) > 1 and x[-1] != x[0] else 1.0
    return np.linalg.qr(np.vander(2 * (x - x[0]) / span - 1, min(order, len(np.unique(x)) - 1) + 1, increasing=True))[0]


def polynomials(x: np.ndarray, order: int) -> np.ndarray:
    return _polynomials(np.ascontiguousarray(x, float).tobytes(), order)


def polynomial(x: np.ndarray, y: np.ndarray, order: int, w: np.ndarray | None = None) -> np.ndarray:
    """Values of the weighted least-squares polynomial."""
    q = polynomials(x, order)
    if w is None:
        return q @ (q.T @ y)
    qw = q * w[:, None]
    gram = qw.T @ q
    try:
        d = np.diag(np.linalg.cholesky(gram))
        if d.min() > 1e-5 * d.max():
            return q @ np.linalg.solve(gram, qw.T @ y)
    except np.linalg.LinAlgError:
        pass  # weights that leave too little: the least norm
    s = np.sqrt(w)
    return q @ np.linalg.lstsq(q * s[:, None], y * s, rcond=None)[0]


@lru_cache(maxsize=64)
def window_projection(length: int, order: int) -> np.ndarray:
    q, _ = np.linalg.qr(np.vander(np.linspace(-1, 1, length), order + 1, increasing=True))
    return q @ q.T


def savgol(y: np.ndarray, length: int, order: int) -> np.ndarray:
    """Values of the polynomials fitted to each window of odd length; the ends take those of the first and last window."""
    hat, half = window_projection(length, order), length // 2
    out = np.empty(len(y))
    out[half : len(y) - half] = np.lib.stride_tricks.sliding_window_view(y, length) @ hat[half]
    out[:half] = hat[:half] @ y[:length]
    out[len(y) - half :] = hat[half + 1 :] @ y[-length:]
    return out


def running(y: np.ndarray, half: int, how) -> np.ndarray:
    """A statistic of neighbours within half places; the ends repeat."""
    if half < 1:
        return y.copy()
    p = np.pad(y, half, mode="edge")
    return how(np.lib.stride_tricks.sliding_window_view(p, 2 * half + 1), axis=-1)


def edged(y: np.ndarray, half: int) -> np.ndarray:
    """y with both ends repeated half times."""
    return np.concatenate([np.full(half, y[0]), y, np.full(half, y[-1])])


def _extreme(y: np.ndarray, half: int, of_two: np.ufunc) -> np.ndarray:
    """running for a minimum or maximum, from windows that double."""
    if half < 1:
        return y.copy()
    v, size, wide = edged(y, half), 1, 2 * half + 1
    while 2 * size <= wide:
        v, size = of_two(v[:-size], v[size:]), 2 * size
    more = wide - size
    return of_two(v[: len(v) - more], v[more:]) if more else v


def erode(y, half):
    return _extreme(y, half, np.minimum)


def dilate(y, half):
    return _extreme(y, half, np.maximum)


def opening(y, half):
    return dilate(erode(y, half), half)


def moving_mean(y: np.ndarray, half: int) -> np.ndarray:
    return running(y, half, np.mean)


def fill_line(mask: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """y where the mask is true, straight lines between."""
    return np.interp(x, x[mask], y[mask]) if mask.any() else np.full(len(y), y.min() if len(y) else 0.0)


def bspline_basis(n: int, knots: int, degree: int) -> np.ndarray:
    """Rows: n even places; columns: B-splines over even knots (Cox and de Boor)."""
    t = np.linspace(0, 1, n)
    step = 1 / max(1, knots - 1)
    full = np.arange(-degree, knots + degree) * step
    b = ((t[:, None] >= full[:-1]) & (t[:, None] < full[1:])).astype(float)
    b[-1] = 0
    b[-1, knots - 2 + degree] = 1
    for d in range(1, degree + 1):
        left = (t[:, None] - full[: -d - 1]) / (full[d:-1] - full[: -d - 1])
        right = (full[d + 1 :] - t[:, None]) / (full[d + 1 :] - full[1:-d])
        b = left * b[:, :-1] + right * b[:, 1:]
    return b


def pspline(y: np.ndarray, w: np.ndarray, lam: float, degree: int = 3, knots: int | None = None, order: int = 2) -> np.ndarray:
    n = len(y)
    b = _basis(n, knots or max(8, min(100, n // 3)), degree)
    d = penalty(b.shape[1], order)
    return b @ np.linalg.solve(b.T @ (b * w[:, None]) + lam * d + 1e-10 * np.eye(b.shape[1]), b.T @ (w * y))


@lru_cache(maxsize=32)
def _basis(n: int, knots: int, degree: int) -> np.ndarray:
    return bspline_basis(n, knots, degree)
