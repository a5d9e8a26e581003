"""Minimisers of a bounded sum of squares under the names that fits can ask for.

All work on the box of bounds: a point outside is moved to its nearest end. Lengths are
measured in units of the box (or of the start, where an end is infinite).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from lumenframe.kernels import peaks


@dataclass
class Problem:
    """Sum of squares of y - f(p), seen from the unit box."""

    f: Callable
    y: np.ndarray
    start: np.ndarray
    low: np.ndarray
    high: np.ndarray
    max_iter: int
    seed: int = 0
    scale: np.ndarray = field(init=False)
    z_low: np.ndarray = field(init=False)
    z_high: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        wide = self.high - self.low
        self.scale = np.where(np.isfinite(wide) & (wide > 0), wide, np.maximum(np.abs(self.start), 1.0))
        self.z_low, self.z_high = self.low / self.scale, self.high / self.scale

    def inside(self, z: np.ndarray) -> np.ndarray:
        return np.clip(z, self.z_low, self.z_high)

    def begin(self) -> np.ndarray:
        return self.inside(self.start / self.scale)

    def cost(self, z: np.ndarray) -> float:
        v = float(((self.y - self.f(self.inside(z) * self.scale)) ** 2).sum())
        return v if np.isfinite(v) else 1e300

    def jacobian(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(residual, derivative of the curve), one-sided differences that stay in the box."""
        at = self.f(z * self.scale)
        jac = np.empty((len(self.y), len(z)))
        for k in range(len(z)):
            h = 1e-7 if z[k] + 1e-7 <= self.z_high[k] else -1e-7
            q = z.copy()
            q[k] += h
            jac[:, k] = (self.f(q * self.scale) - at) / h
        return self.y - at, jac

    def slope(self, z: np.ndarray) -> np.ndarray:
        r, jac = self.jacobian(z)
        return -2 * jac.T @ r

    def free(self, z: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Coordinates that may move against the slope."""
        return ~(((z <= self.z_low) & (g > 0)) | ((z >= self.z_high) & (g < 0)))

    def backtrack(self, z: np.ndarray, c: float, g: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, float]:
        """The first of halved steps along d, bent to the box, that lowers the cost enough; z itself if none does."""
        t = 1.0
        for _ in range(30):
            q = self.inside(z + t * d)
            new = self.cost(q)
            if new <= c + 1e-4 * min(0.0, float(g @ (q - z))) and new < c:
                return q, new
            t /= 2
        return z, c


def _quasi_newton(p: Problem, direction: Callable) -> np.ndarray:
    """Descent along directions of a memory of (step, change of slope); steepest descent when one fails."""
    z = p.begin()
    c, g = p.cost(z), p.slope(z)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(4 * p.max_iter):
        free = p.free(z, g)
        own = np.where(free, g, 0.0)
        if np.abs(own).max(initial=0.0) <= 1e-12 * (1 + c):
            break
        d = np.where(free, direction(own, memory), 0.0)
        if own @ d >= 0:
            memory.clear()
            d = -own
        if not memory:
            d = d / max(1e-300, np.linalg.norm(d)) * 0.1
        q, new = p.backtrack(z, c, g, d)
        if new >= c:
            if not memory:
                break
            memory.clear()
            continue
        h = p.slope(q)
        s, u = q - z, h - g
        if s @ u > 1e-14 * np.linalg.norm(s) * np.linalg.norm(u):
            memory.append((s, u))
        done = c - new <= 1e-11 * c
        z, c, g = q, new, h
        if done:
            break
    return z


def _two_loops(g: np.ndarray, memory: list) -> np.ndarray:
    """Inverse of the remembered curvature times -g."""
    q, used = g.copy(), []
    for s, u in reversed(memory):
        a = (s @ q) / (s @ u)
        q = q - a * u
        used.append(a)
    if memory:
        s, u = memory[-1]
        q = q * ((s @ u) / (u @ u))
    for (s, u), a in zip(memory, reversed(used), strict=True):
        q = q + s * (a - (u @ q) / (s @ u))
    return -q


def bfgs(p: Problem) -> np.ndarray:
    return _quasi_newton(p, _two_loops)


def lbfgsb(p: Problem) -> np.ndarray:
    return _quasi_newton(p, lambda g, memory: _two_loops(g, memory[-10:]))


def conjugate_gradient(p: Problem) -> np.ndarray:
    """Polak-Ribiere directions from the last two slopes, never against descent, with the length that the last curvature suggests."""

    def direction(g: np.ndarray, memory: list) -> np.ndarray:
        if not memory:
            return -g
        s, u = memory[-1]
        before = g - u
        b = max(0.0, (g @ u) / max(before @ before, 1e-300))
        d = -g + b * s * (np.linalg.norm(before) / max(np.linalg.norm(s), 1e-300))
        return d * ((s @ s) / (s @ u))

    return _quasi_newton(p, direction)


def truncated_newton(p: Problem) -> np.ndarray:
    """Newton steps of the Gauss-Newton curvature, solved by conjugate gradients that stop early."""
    z = p.begin()
    c = p.cost(z)
    for _ in range(p.max_iter):
        r, jac = p.jacobian(z)
        g = -2 * jac.T @ r
        free = p.free(z, g)
        j = jac[:, free]
        x, rest = np.zeros(j.shape[1]), -g[free]
        d, size = rest.copy(), rest @ rest
        enough = min(0.25, np.sqrt(np.sqrt(size))) ** 2 * size * 1e-4
        for _ in range(2 * len(x)):
            if size <= enough or not len(x):
                break
            h = 2 * (j.T @ (j @ d)) + 1e-12 * d
            a = size / max(d @ h, 1e-300)
            x, rest = x + a * d, rest - a * h
            size, old = rest @ rest, size
            d = rest + size / old * d
        step = np.zeros(len(z))
        step[free] = x
        q, new = p.backtrack(z, c, g, step)
        if c - new <= 1e-12 * c:
            return q
        z, c = q, new
    return z


def trust_region(p: Problem) -> np.ndarray:
    """Dogleg between the steepest and the Gauss-Newton step within a radius, bent to the box."""
    z, radius = p.begin(), 0.25
    c = p.cost(z)
    r, jac = p.jacobian(z)
    for _ in range(2 * p.max_iter):
        g = -2 * jac.T @ r
        free = p.free(z, g)
        j, own = jac[:, free], g[free]
        if not free.any() or np.abs(own).max() <= 1e-12 * (1 + c):
            break
        newton = np.linalg.lstsq(j, r, rcond=1e-10)[0]
        steep = -own * ((own @ own) / max(2 * ((j @ own) ** 2).sum(), 1e-300))
        if np.linalg.norm(newton) <= radius:
            x = newton
        elif np.linalg.norm(steep) >= radius:
            x = steep / np.linalg.norm(steep) * radius
        else:
            d = newton - steep
            a, b, e = d @ d, 2 * steep @ d, steep @ steep - radius**2
            x = steep + d * (-b + np.sqrt(max(b * b - 4 * a * e, 0.0))) / (2 * a)
        step = np.zeros(len(z))
        step[free] = x
        q = p.inside(z + step)
        moved = q - z
        told = c - float(((r - jac @ moved) ** 2).sum())
        new = p.cost(q)
        ratio = (c - new) / told if told > 0 else -1.0
        radius = radius / 4 if ratio < 0.25 else min(2.0, 2 * radius) if ratio > 0.75 else radius
        if new < c:
            small = c - new <= 1e-12 * c
            z, c = q, new
            r, jac = p.jacobian(z)
            if small:
                break
        elif radius < 1e-9:
            break
    return z


def sequential_quadratic(p: Problem) -> np.ndarray:
    """Each step solves the quadratic model in the box, coordinate by coordinate, then searches along it."""
    z = p.begin()
    c = p.cost(z)
    for _ in range(p.max_iter):
        r, jac = p.jacobian(z)
        g, h = -2 * jac.T @ r, 2 * jac.T @ jac
        x = np.zeros(len(z))
        for _ in range(500):
            before = x.copy()
            for k in range(len(z)):
                x[k] = np.clip(x[k] - (g[k] + h[k] @ x) / max(h[k, k], 1e-300), p.z_low[k] - z[k], p.z_high[k] - z[k])
            if np.abs(x - before).max() < 1e-10:
                break
        q, new = p.backtrack(z, c, g, x)
        if c - new <= 1e-12 * c:
            return q
        z, c = q, new
    return z


def _simplex(cost: Callable, z: np.ndarray, inside: Callable, rounds: int, size: float = 0.05) -> np.ndarray:
    """Nelder-Mead with coefficients that adapt to the number of parameters."""
    n = len(z)
    corners = [z, *(inside(z + size * e) if not np.allclose(inside(z + size * e), z) else inside(z - size * e) for e in np.eye(n))]
    s, v = np.array(corners), np.array([cost(q) for q in corners])
    expand, contract, shrink = 1 + 2 / n, 0.75 - 1 / (2 * n), 1 - 1 / max(n, 2)
    for _ in range(rounds):
        order = np.argsort(v, kind="stable")
        s, v = s[order], v[order]
        if v[-1] - v[0] <= 1e-12 * (abs(v[0]) + 1e-300) and np.abs(s[1:] - s[0]).max() < 1e-7:
            break
        middle = s[:-1].mean(axis=0)
        away = middle - s[-1]
        q = inside(middle + away)
        new = cost(q)
        if new < v[0]:
            far = inside(middle + expand * away)
            beyond = cost(far)
            q, new = (far, beyond) if beyond < new else (q, new)
        elif new >= v[-2]:
            near = inside(middle + (contract if new < v[-1] else -contract) * away)
            closer = cost(near)
            if closer >= min(new, v[-1]):
                s[1:] = s[0] + shrink * (s[1:] - s[0])
                v[1:] = [cost(x) for x in s[1:]]
                continue
            q, new = near, closer
        s[-1], v[-1] = q, new
    return s[np.argmin(v)]


def nelder_mead(p: Problem) -> np.ndarray:
    """Simplex search, started again around its own end while that helps."""
    z = p.begin()
    for _ in range(6):
        q = _simplex(p.cost, z, p.inside, 40 * p.max_iter)
        if p.cost(z) - p.cost(q) <= 1e-9 * p.cost(z):
            return q
        z = q
    return z


def _along(p: Problem, z: np.ndarray, c: float, d: np.ndarray) -> tuple[np.ndarray, float]:
    """The lowest point found on the line of d within the box: a grid, then golden sections around its best."""
    with np.errstate(divide="ignore", invalid="ignore"):
        ends = np.where(d != 0, np.stack([(p.z_low - z) / d, (p.z_high - z) / d]), np.array([[-np.inf], [np.inf]]))
    lo, hi = max(ends.min(axis=0).max(), -2.0), min(ends.max(axis=0).min(), 2.0)
    if not hi > lo:
        return z, c
    reach = np.array([0.0, *np.geomspace(1e-4, 1, 9)])
    t = np.unique(np.concatenate([reach[reach <= hi], -reach[-reach >= lo], [lo, hi]]))
    v = np.array([p.cost(z + s * d) for s in t])
    k = int(np.argmin(v))
    a, b, golden = t[max(0, k - 1)], t[min(len(t) - 1, k + 1)], (np.sqrt(5) - 1) / 2
    x, y = b - golden * (b - a), a + golden * (b - a)
    fx, fy = p.cost(z + x * d), p.cost(z + y * d)
    for _ in range(40):
        if fx < fy:
            b, y, fy = y, x, fx
            x = b - golden * (b - a)
            fx = p.cost(z + x * d)
        else:
            a, x, fx = x, y, fy
            y = a + golden * (b - a)
            fy = p.cost(z + y * d)
    best, new = (x, fx) if fx < fy else (y, fy)
    best, new = (t[k], v[k]) if v[k] < new else (best, new)
    return (p.inside(z + best * d), new) if new < c else (z, c)


def powell(p: Problem) -> np.ndarray:
    """Searches along a set of directions; the way of a whole round takes the place of its most useful direction."""
    z, ways = p.begin(), list(np.eye(len(p.start)))
    c = p.cost(z)
    for _ in range(p.max_iter):
        z0, c0, falls = z, c, []
        for d in ways:
            before = c
            z, c = _along(p, z, c, d)
            falls.append(before - c)
        way = z - z0
        if np.linalg.norm(way) > 0:
            z, c = _along(p, z, c, way)
            ways[int(np.argmax(falls))] = way / np.linalg.norm(way)
            if np.linalg.matrix_rank(np.array(ways), 1e-6) < len(ways):
                ways = list(np.eye(len(z)))
        if c0 - c <= 1e-10 * c0:
            break
    return z


def linear_models(p: Problem) -> np.ndarray:
    """Steps of one radius on the linear model of a simplex's values; the radius halves when they don't help. A small simplex search ends it."""
    z, radius = p.begin(), 0.1
    c, n = p.cost(z), len(z)
    while radius > 1e-6:
        offsets = np.where((z + radius <= p.z_high)[:, None], 1.0, -1.0) * np.eye(n) * radius
        values = np.array([p.cost(z + o) for o in offsets])
        g = (values - c) / offsets.diagonal()
        own = np.where(p.free(z, g), g, 0.0)
        k = int(np.argmin(values))
        q = p.inside(z - radius * own / max(np.linalg.norm(own), 1e-300))
        new = p.cost(q)
        if values[k] < new:
            q, new = p.inside(z + offsets[k]), values[k]
        back = p.inside(z - offsets[int(np.argmax(values))])
        if p.cost(back) < new:
            q, new = back, p.cost(back)
        if new < c - 1e-7 * c:
            z, c = q, new
        else:
            radius /= 2
    return _simplex(p.cost, z, p.inside, 20 * p.max_iter, 1e-2)


def _levenberg(p: Problem, z: np.ndarray) -> np.ndarray:
    return peaks.least_squares(p.f, z * p.scale, p.low, p.high, p.y, max_iter=p.max_iter)[0] / p.scale


def least_squares(p: Problem) -> np.ndarray:
    return _levenberg(p, p.begin())


def basin_hopping(p: Problem, hops: int = 20) -> np.ndarray:
    """Local fits from seeded jumps; a worse basin is taken with a chance that falls with its cost."""
    rng = np.random.default_rng(p.seed)
    z = best = _levenberg(p, p.begin())
    c = lowest = p.cost(z)
    heat = 0.1 * max(c, 1e-300)
    for _ in range(hops):
        q = _levenberg(p, p.inside(z + rng.uniform(-0.25, 0.25, len(z))))
        new = p.cost(q)
        if new < c or rng.random() < np.exp(-(new - c) / heat):
            z, c = q, new
        if c < lowest:
            best, lowest = z, c
    return best


def tunnelling(p: Problem, rounds: int = 4, tries: int = 3) -> np.ndarray:
    """Local fits joined by tunnels: the distance to a slightly better cost, raised near the minima kept in memory, is minimised."""
    rng = np.random.default_rng(p.seed)
    best = _levenberg(p, p.begin())
    lowest, known = p.cost(best), [best]
    for _ in range(rounds):
        aim = lowest * (1 - 0.01)
        found = None
        for _ in range(tries):
            near = np.array(known[-5:])
            tunnel = lambda z, near=near: (p.cost(z) - aim) ** 2 / max(float(np.prod(np.linalg.norm(near - z, axis=1))), 1e-12)
            q = _levenberg(p, p.inside(_simplex(tunnel, p.inside(known[-1] + rng.normal(0, 0.1, len(best))), p.inside, p.max_iter)))
            known.append(q)
            if p.cost(q) < aim:
                found = q
                break
        if found is None:
            break
        best, lowest = found, p.cost(found)
    return best


#: The names of the methods.
METHODS: dict[str, Callable[[Problem], np.ndarray]] = {
    "least_squares": least_squares,
    "leastsq": least_squares,
    "basinhopping": basin_hopping,
    "ampgo": tunnelling,
    "nelder": nelder_mead,
    "lbfgsb": lbfgsb,
    "powell": powell,
    "cg": conjugate_gradient,
    "cobyla": linear_models,
    "bfgs": bfgs,
    "tnc": truncated_newton,
    "trust-constr": trust_region,
    "slsqp": sequential_quadratic,
}


def minimise(method: str, f: Callable, start: np.ndarray, low: np.ndarray, high: np.ndarray, y: np.ndarray, max_iter: int = 100, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(values, Jacobian) of the fit by a named method."""
    if method not in METHODS:
        raise ValueError(f"no fit method {method}; there are {', '.join(METHODS)}")
    p = Problem(f, y, start, low, high, max_iter, seed)
    z = p.inside(METHODS[method](p))
    return np.clip(z * p.scale, low, high), p.jacobian(z)[1] / p.scale
