"""The fit methods of optimizers, stepped over many spectra of one axis at once.

Each row takes the steps that optimizers takes for it alone; rows that have ended drop out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

Rows = np.ndarray


def _norm(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=-1))


def _least_norm(m: np.ndarray, g: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Least-squares solutions of least norm of the free parts of symmetric systems."""
    vals, vecs = np.linalg.eigh(m * (free[:, :, None] & free[:, None, :]))
    size = np.abs(vals)
    kept = size > np.finfo(float).eps * free.sum(axis=1, keepdims=True) * size.max(axis=1, keepdims=True)
    turned = (vecs.transpose(0, 2, 1) @ np.where(free, g, 0.0)[:, :, None])[:, :, 0]
    return (vecs @ np.where(kept, turned / np.where(kept, vals, 1.0), 0.0)[:, :, None])[:, :, 0]


def _least_norm_each(m: np.ndarray, g: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The same by the solver of a single fit, row by row."""
    out = np.zeros(g.shape)
    for i, own in enumerate(free):
        if own.any():
            out[i, own] = np.linalg.lstsq(m[i][np.ix_(own, own)], g[i, own], rcond=None)[0]
    return out


def levenberg(f: Callable, start: np.ndarray, low: np.ndarray, high: np.ndarray, y: np.ndarray, max_iter: int = 100, tol: float = 1e-8, alike: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """peaks.least_squares of each row: (values, Jacobians).

    alike: sums and steps are rounded as a single fit rounds them, which matters where the steps are ill conditioned; faster if not.
    """
    k, eye = start.shape[1], np.eye(start.shape[1])
    p, damp = np.clip(start.astype(float), low, high), np.full(len(start), 1e-2)
    curve = f(p)
    cost = ((y - curve) ** 2).sum(axis=1)
    jac, at = np.zeros((*y.shape, k)), np.arange(len(start))
    for _ in range(max_iter):
        if not len(at):
            break
        own, lo, hi, was, now = p[at], low[at], high[at], cost[at], curve[at]
        h = 1e-6 * np.maximum(np.abs(own), 1e-3)
        moved = np.where(own + h <= hi, own + h, own - h)
        j = np.empty((*now.shape, k))
        for i in range(k):
            q = own.copy()
            q[:, i] = moved[:, i]
            j[:, :, i] = (f(q) - now) / (moved[:, i] - own[:, i])[:, None]
        jac[at] = j
        rest = y[at] - now
        if alike:
            g, a = np.array([u.T @ r for u, r in zip(j, rest, strict=True)]), np.array([u.T @ u for u in j])
        else:
            back = j.transpose(0, 2, 1)
            g, a = (back @ rest[:, :, None])[:, :, 0], back @ j
        free = ~(((own <= lo) & (g < 0)) | ((own >= hi) & (g > 0)))
        bend = np.maximum(np.diagonal(a, axis1=1, axis2=2), 1e-12)
        todo, better = np.arange(len(at)), np.zeros(len(at), bool)
        q, new_curve, new = own.copy(), now.copy(), was.copy()
        for _ in range(12):
            if not len(todo):
                break
            step = (_least_norm_each if alike else _least_norm)(a[todo] + (damp[at[todo], None] * bend[todo])[:, :, None] * eye, g[todo], free[todo])
            t = np.clip(own[todo] + step, lo[todo], hi[todo])
            c = f(t)
            v = ((y[at[todo]] - c) ** 2).sum(axis=1)
            ok = np.isfinite(v) & (v < was[todo])
            won, todo = todo[ok], todo[~ok]
            better[won], q[won], new_curve[won], new[won] = True, t[ok], c[ok], v[ok]
            damp[at[todo]] *= 4
        small = (was - new < tol * was) & (_norm(q - own) < 1e-6 * (_norm(own) + 1e-6))
        won = at[better]
        p[won], curve[won], cost[won], damp[won] = q[better], new_curve[better], new[better], np.maximum(damp[won] / 5, 1e-12)
        at = at[better & ~small & (new >= 1e-28)]
    return p, jac


@dataclass
class Problems:
    """optimizers.Problem for each row of y; `rows` name those that points z belong to."""

    f: Callable
    y: np.ndarray
    start: np.ndarray
    low: np.ndarray
    high: np.ndarray
    max_iter: int = 100
    seed: int = 0
    scale: np.ndarray = field(init=False)
    z_low: np.ndarray = field(init=False)
    z_high: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        wide = self.high - self.low
        self.scale = np.where(np.isfinite(wide) & (wide > 0), wide, np.maximum(np.abs(self.start), 1.0))
        self.z_low, self.z_high = self.low / self.scale, self.high / self.scale

    def inside(self, z: np.ndarray, rows: Rows) -> np.ndarray:
        return np.clip(z, self.z_low[rows], self.z_high[rows])

    def all_rows(self) -> Rows:
        return np.arange(len(self.y))

    def begin(self) -> np.ndarray:
        return self.inside(self.start / self.scale, self.all_rows())

    def cost(self, z: np.ndarray, rows: Rows) -> np.ndarray:
        v = ((self.y[rows] - self.f(self.inside(z, rows) * self.scale[rows])) ** 2).sum(axis=1)
        return np.where(np.isfinite(v), v, 1e300)

    def jacobian(self, z: np.ndarray, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        at = self.f(z * self.scale[rows])
        jac = np.empty((*at.shape, z.shape[1]))
        for k in range(z.shape[1]):
            h = np.where(z[:, k] + 1e-7 <= self.z_high[rows, k], 1e-7, -1e-7)
            q = z.copy()
            q[:, k] += h
            jac[:, :, k] = (self.f(q * self.scale[rows]) - at) / h[:, None]
        return self.y[rows] - at, jac

    def slope(self, z: np.ndarray, rows: Rows) -> np.ndarray:
        r, jac = self.jacobian(z, rows)
        return (-2 * jac.transpose(0, 2, 1) @ r[:, :, None])[:, :, 0]

    def free(self, z: np.ndarray, g: np.ndarray, rows: Rows) -> np.ndarray:
        return ~(((z <= self.z_low[rows]) & (g > 0)) | ((z >= self.z_high[rows]) & (g < 0)))

    def backtrack(self, z: np.ndarray, c: np.ndarray, g: np.ndarray, d: np.ndarray, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        out, value, todo, t = z.copy(), c.copy(), np.arange(len(rows)), 1.0
        for _ in range(30):
            if not len(todo):
                break
            q = self.inside(z[todo] + t * d[todo], rows[todo])
            new = self.cost(q, rows[todo])
            ok = (new <= c[todo] + 1e-4 * np.minimum(0.0, (g[todo] * (q - z[todo])).sum(axis=1))) & (new < c[todo])
            out[todo[ok]], value[todo[ok]] = q[ok], new[ok]
            todo, t = todo[~ok], t / 2
        return out, value


def _levenberg(p: Problems, z: np.ndarray, rows: Rows) -> np.ndarray:
    return levenberg(p.f, z * p.scale[rows], p.low[rows], p.high[rows], p.y[rows], p.max_iter, alike=False)[0] / p.scale[rows]


def _two_loops(g: np.ndarray, steps: np.ndarray, turns: np.ndarray, rows: Rows, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """optimizers._two_loops over the pairs first to last (exclusive) of each row."""
    q, used = g.copy(), {}
    pairs = range(int(last.max()) - 1, int(first.min()) - 1, -1)
    held = {}
    for i in pairs:
        held[i] = r = np.flatnonzero((first <= i) & (i < last))
        s, u = steps[rows[r], i], turns[rows[r], i]
        used[i] = a = (s * q[r]).sum(axis=1) / (s * u).sum(axis=1)
        q[r] -= a[:, None] * u
    r = np.flatnonzero(last > first)
    s, u = steps[rows[r], last[r] - 1], turns[rows[r], last[r] - 1]
    q[r] *= ((s * u).sum(axis=1) / (u * u).sum(axis=1))[:, None]
    for i in reversed(pairs):
        r = held[i]
        s, u = steps[rows[r], i], turns[rows[r], i]
        q[r] += s * (used[i] - (u * q[r]).sum(axis=1) / (s * u).sum(axis=1))[:, None]
    return -q


def _quasi_newton(p: Problems, memory: int) -> np.ndarray:
    rows = p.all_rows()
    z = p.begin()
    c, g = p.cost(z, rows), p.slope(z, rows)
    n, k = z.shape
    steps, turns, held = np.zeros((n, 8, k)), np.zeros((n, 8, k)), np.zeros(n, int)
    for _ in range(4 * p.max_iter):
        own = np.where(p.free(z[rows], g[rows], rows), g[rows], 0.0)
        go = np.abs(own).max(axis=1) > 1e-12 * (1 + c[rows])
        rows, own = rows[go], own[go]
        if not len(rows):
            break
        first = np.maximum(0, held[rows] - memory)
        d = np.where(p.free(z[rows], g[rows], rows), _two_loops(own, steps, turns, rows, first, held[rows]), 0.0)
        up = ~((own * d).sum(axis=1) < 0)
        held[rows[up]] = 0
        d[up] = -own[up]
        bare = held[rows] == 0
        d[bare] = d[bare] / np.maximum(1e-300, _norm(d[bare]))[:, None] * 0.1
        q, new = p.backtrack(z[rows], c[rows], g[rows], d, rows)
        stuck = new >= c[rows]
        over = stuck & bare
        held[rows[stuck]] = 0
        moved = np.flatnonzero(~stuck)
        r = rows[moved]
        if len(r):
            h = p.slope(q[moved], r)
            s, u = q[moved] - z[r], h - g[r]
            keep = (s * u).sum(axis=1) > 1e-14 * _norm(s) * _norm(u)
            if held[r].max() >= steps.shape[1]:
                steps, turns = (np.concatenate([v, np.zeros_like(v)], axis=1) for v in (steps, turns))
            steps[r[keep], held[r[keep]]], turns[r[keep], held[r[keep]]] = s[keep], u[keep]
            held[r[keep]] += 1
            over[moved] = c[r] - new[moved] <= 1e-11 * c[r]
            z[r], c[r], g[r] = q[moved], new[moved], h
        rows = rows[~over]
    return z


def bfgs(p: Problems) -> np.ndarray:
    return _quasi_newton(p, 1 << 30)


def lbfgsb(p: Problems) -> np.ndarray:
    return _quasi_newton(p, 10)


def sequential_quadratic(p: Problems) -> np.ndarray:
    z, rows = p.begin(), p.all_rows()
    c = p.cost(z, rows)
    for _ in range(p.max_iter):
        if not len(rows):
            break
        own = z[rows]
        r, jac = p.jacobian(own, rows)
        back = jac.transpose(0, 2, 1)
        g, h = (-2 * back @ r[:, :, None])[:, :, 0], 2 * back @ jac
        lo, hi = p.z_low[rows] - own, p.z_high[rows] - own
        x, todo = np.zeros(own.shape), np.arange(len(rows))
        for _ in range(500):
            if not len(todo):
                break
            before, v, hh, gg = x[todo], x[todo].copy(), h[todo], g[todo]
            for k in range(own.shape[1]):
                v[:, k] = np.clip(v[:, k] - (gg[:, k] + (hh[:, k] * v).sum(axis=1)) / np.maximum(hh[:, k, k], 1e-300), lo[todo, k], hi[todo, k])
            x[todo] = v
            todo = todo[~(np.abs(v - before).max(axis=1) < 1e-10)]
        q, new = p.backtrack(own, c[rows], g, x, rows)
        done = c[rows] - new <= 1e-12 * c[rows]
        z[rows], c[rows] = q, new
        rows = rows[~done]
    return z


def _simplex(cost: Callable, p: Problems, z: np.ndarray, rows: Rows, rounds: int, size: float = 0.05) -> np.ndarray:
    """cost(points, positions in rows)."""
    n, out, at = z.shape[1], z.copy(), np.arange(len(rows))
    if not len(rows):
        return out
    corners = [z]
    for e in np.eye(n):
        up, down = p.inside(z + size * e, rows), p.inside(z - size * e, rows)
        same = (np.abs(up - z) <= 1e-8 + 1e-5 * np.abs(z)).all(axis=1)
        corners.append(np.where(same[:, None], down, up))
    s = np.stack(corners, axis=1)
    v = np.stack([cost(q, at) for q in corners], axis=1)
    expand, contract, shrink = 1 + 2 / n, 0.75 - 1 / (2 * n), 1 - 1 / max(n, 2)
    for _ in range(rounds):
        order = np.argsort(v, axis=1, kind="stable")
        s, v = np.take_along_axis(s, order[:, :, None], axis=1), np.take_along_axis(v, order, axis=1)
        done = (v[:, -1] - v[:, 0] <= 1e-12 * (np.abs(v[:, 0]) + 1e-300)) & (np.abs(s[:, 1:] - s[:, :1]).max(axis=(1, 2)) < 1e-7)
        if done.any():
            out[at[done]] = s[done, 0]
            at, s, v = at[~done], s[~done], v[~done]
            if not len(at):
                return out
        middle = s[:, :-1].mean(axis=1)
        away = middle - s[:, -1]
        q = p.inside(middle + away, rows[at])
        new = cost(q, at)
        i = np.flatnonzero(new < v[:, 0])
        if len(i):
            far = p.inside(middle[i] + expand * away[i], rows[at[i]])
            beyond = cost(far, at[i])
            won = beyond < new[i]
            q[i[won]], new[i[won]] = far[won], beyond[won]
        i = np.flatnonzero((new >= v[:, -2]) & (new >= v[:, 0]))
        lost = np.zeros(len(at), bool)
        if len(i):
            near = p.inside(middle[i] + np.where(new[i] < v[i, -1], contract, -contract)[:, None] * away[i], rows[at[i]])
            closer = cost(near, at[i])
            bad = closer >= np.minimum(new[i], v[i, -1])
            lost[i[bad]] = True
            q[i[~bad]], new[i[~bad]] = near[~bad], closer[~bad]
        i = np.flatnonzero(lost)
        if len(i):
            s[i, 1:] = s[i, :1] + shrink * (s[i, 1:] - s[i, :1])
            for k in range(1, n + 1):
                v[i, k] = cost(s[i, k], at[i])
        i = np.flatnonzero(~lost)
        s[i, -1], v[i, -1] = q[i], new[i]
    out[at] = s[np.arange(len(at)), np.argmin(v, axis=1)]
    return out


def _simplex_of(p: Problems, z: np.ndarray, rows: Rows, rounds: int, size: float = 0.05) -> np.ndarray:
    return _simplex(lambda q, at: p.cost(q, rows[at]), p, z, rows, rounds, size)


def nelder_mead(p: Problems) -> np.ndarray:
    z, rows = p.begin(), p.all_rows()
    for _ in range(6):
        q = _simplex_of(p, z[rows], rows, 40 * p.max_iter)
        before = p.cost(z[rows], rows)
        helped = before - p.cost(q, rows) > 1e-9 * before
        z[rows] = q
        rows = rows[helped]
    return z


def _along(p: Problems, z: np.ndarray, c: np.ndarray, d: np.ndarray, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(divide="ignore", invalid="ignore"):
        one, two = (p.z_low[rows] - z) / d, (p.z_high[rows] - z) / d
    still = d == 0
    least, most = np.where(still, -np.inf, np.minimum(one, two)), np.where(still, np.inf, np.maximum(one, two))
    lo, hi = np.maximum(least.max(axis=1), -2.0), np.minimum(most.min(axis=1), 2.0)
    use = np.flatnonzero(hi > lo)
    z_out, c_out = z.copy(), c.copy()
    if not len(use):
        return z_out, c_out
    z, c, d, rows, lo, hi = z[use], c[use], d[use], rows[use], lo[use], hi[use]
    reach = np.array([0.0, *np.geomspace(1e-4, 1, 9)])
    up, down = np.broadcast_to(reach, (len(use), 10)), np.broadcast_to(-reach[1:], (len(use), 9))
    t = np.sort(np.concatenate([np.where(up <= hi[:, None], up, np.inf), np.where(down >= lo[:, None], down, np.inf), np.where((lo <= 0) & (hi < 0), -0.0, np.inf)[:, None], lo[:, None], hi[:, None]], axis=1), axis=1)
    t[:, 1:][t[:, 1:] == t[:, :-1]] = np.inf
    t = np.sort(t, axis=1)
    count = np.isfinite(t).sum(axis=1)
    v = np.full(t.shape, np.inf)
    for j in range(int(count.max())):
        i = np.flatnonzero(j < count)
        v[i, j] = p.cost(z[i] + t[i, j, None] * d[i], rows[i])
    i = np.arange(len(use))
    k = np.argmin(v, axis=1)
    a, b, golden = t[i, np.maximum(0, k - 1)], t[i, np.minimum(count - 1, k + 1)], (np.sqrt(5) - 1) / 2
    x, y = b - golden * (b - a), a + golden * (b - a)
    at = lambda s: p.cost(z + s[:, None] * d, rows)
    fx, fy = at(x), at(y)
    for _ in range(40):
        left = fx < fy
        a, b = np.where(left, a, x), np.where(left, y, b)
        new = np.where(left, b - golden * (b - a), a + golden * (b - a))
        value = at(new)
        x, y, fx, fy = np.where(left, new, y), np.where(left, x, new), np.where(left, value, fy), np.where(left, fx, value)
    best, new = np.where(fx < fy, x, y), np.where(fx < fy, fx, fy)
    grid = v[i, k] < new
    best, new = np.where(grid, t[i, k], best), np.where(grid, v[i, k], new)
    won = new < c
    z_out[use[won]] = p.inside(z + best[:, None] * d, rows)[won]
    c_out[use[won]] = new[won]
    return z_out, c_out


def powell(p: Problems) -> np.ndarray:
    z, rows = p.begin(), p.all_rows()
    c, n = p.cost(z, rows), z.shape[1]
    ways = np.broadcast_to(np.eye(n), (len(rows), n, n)).copy()
    for _ in range(p.max_iter):
        if not len(rows):
            break
        z0, c0, falls = z[rows], c[rows], []
        for k in range(n):
            before = c[rows]
            z[rows], c[rows] = _along(p, z[rows], before, ways[rows, k], rows)
            falls.append(before - c[rows])
        way = z[rows] - z0
        moved = np.flatnonzero(_norm(way) > 0)
        if len(moved):
            r = rows[moved]
            z[r], c[r] = _along(p, z[r], c[r], way[moved], r)
            ways[r, np.argmax(np.array(falls), axis=0)[moved]] = way[moved] / _norm(way[moved])[:, None]
            flat = np.linalg.matrix_rank(ways[r], 1e-6) < n
            ways[r[flat]] = np.eye(n)
        rows = rows[c0 - c[rows] > 1e-10 * c0]
    return z


def linear_models(p: Problems) -> np.ndarray:
    z, rows = p.begin(), p.all_rows()
    c, n = p.cost(z, rows), z.shape[1]
    radius = np.full(len(rows), 0.1)
    while len(rows):
        own, r = z[rows], radius[rows, None]
        sides = np.where(own + r <= p.z_high[rows], r, -r)
        values = np.stack([p.cost(own + sides * e, rows) for e in np.eye(n)], axis=1)
        g = (values - c[rows, None]) / sides
        down = np.where(p.free(own, g, rows), g, 0.0)
        i, k = np.arange(len(rows)), np.argmin(values, axis=1)
        q = p.inside(own - r * down / np.maximum(_norm(down), 1e-300)[:, None], rows)
        new = p.cost(q, rows)
        corner = values[i, k] < new
        q[corner] = p.inside(own + sides * np.eye(n)[k], rows)[corner]
        new = np.where(corner, values[i, k], new)
        back = p.inside(own - sides * np.eye(n)[np.argmax(values, axis=1)], rows)
        behind = p.cost(back, rows)
        q[behind < new], new = back[behind < new], np.minimum(new, behind)
        won = new < c[rows] - 1e-7 * c[rows]
        z[rows[won]], c[rows[won]] = q[won], new[won]
        radius[rows[~won]] /= 2
        rows = rows[radius[rows] > 1e-6]
    return _simplex_of(p, z, p.all_rows(), 20 * p.max_iter, 1e-2)


def least_squares(p: Problems) -> np.ndarray:
    return _levenberg(p, p.begin(), p.all_rows())


def basin_hopping(p: Problems, hops: int = 20) -> np.ndarray:
    rows = p.all_rows()
    chance = [np.random.default_rng(p.seed) for _ in rows]
    z = _levenberg(p, p.begin(), rows)
    c = p.cost(z, rows)
    best, lowest, heat = z.copy(), c.copy(), 0.1 * np.maximum(c, 1e-300)
    for _ in range(hops):
        jump = np.array([g.uniform(-0.25, 0.25, z.shape[1]) for g in chance])
        q = _levenberg(p, p.inside(z + jump, rows), rows)
        new = p.cost(q, rows)
        taken = new < c
        for i in np.flatnonzero(~taken):
            taken[i] = chance[i].random() < np.exp(-(new[i] - c[i]) / heat[i])
        z[taken], c[taken] = q[taken], new[taken]
        better = c < lowest
        best[better], lowest[better] = z[better], c[better]
    return best


def tunnelling(p: Problems, rounds: int = 4, tries: int = 3) -> np.ndarray:
    rows = p.all_rows()
    chance = [np.random.default_rng(p.seed) for _ in rows]
    best = _levenberg(p, p.begin(), rows)
    n, lowest = best.shape[1], p.cost(best, rows)
    known, count = np.full((len(rows), 1 + rounds * tries, n), np.nan), np.ones(len(rows), int)
    known[:, 0] = best
    for _ in range(rounds):
        aim = lowest * (1 - 0.01)
        found, open_ = np.zeros(len(best), bool), rows
        for _ in range(tries):
            if not len(open_):
                break
            last = np.stack([known[open_, np.maximum(count[open_] - 1 - j, 0)] for j in range(4, -1, -1)], axis=1)
            absent = np.stack([count[open_] - 1 - j < 0 for j in range(4, -1, -1)], axis=1)

            def tunnel(z, at, own=open_, last=last, absent=absent, aim=aim):
                gaps = np.where(absent[at], 1.0, _norm(last[at] - z[:, None]))
                return (p.cost(z, own[at]) - aim[own[at]]) ** 2 / np.maximum(gaps.prod(axis=1), 1e-12)

            jump = np.array([chance[i].normal(0, 0.1, n) for i in open_])
            low = _simplex(tunnel, p, p.inside(last[:, -1] + jump, open_), open_, p.max_iter)
            q = _levenberg(p, p.inside(low, open_), open_)
            known[open_, count[open_]] = q
            count[open_] += 1
            new = p.cost(q, open_)
            won = new < aim[open_]
            r = open_[won]
            found[r], best[r], lowest[r] = True, q[won], new[won]
            open_ = open_[~won]
        rows = rows[found[rows]]
        if not len(rows):
            break
    return best


#: The methods of optimizers.METHODS that have steps for many rows; the others run row by row.
METHODS: dict[str, Callable[[Problems], np.ndarray]] = {
    "basinhopping": basin_hopping, "ampgo": tunnelling, "nelder": nelder_mead, "lbfgsb": lbfgsb, "powell": powell, "cobyla": linear_models, "bfgs": bfgs, "slsqp": sequential_quadratic,
}


def minimise(method: str, f: Callable, start: np.ndarray, low: np.ndarray, high: np.ndarray, y: np.ndarray, max_iter: int = 100, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(values, Jacobians) of the fits of all rows by a named method."""
    if method in ("least_squares", "leastsq"):
        return levenberg(f, start, low, high, y, max_iter)
    p = Problems(f, y, start, low, high, max_iter, seed)
    rows = p.all_rows()
    z = p.inside(METHODS[method](p), rows)
    return np.clip(z * p.scale, low, high), p.jacobian(z, rows)[1] / p.scale[:, None]
