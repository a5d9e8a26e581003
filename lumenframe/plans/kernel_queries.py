"""SQL for kernels whose steps a database can also take: windows of neighbours, polynomials, shapes by series and sums.

Each SQL is written from the definition, not from the kernel: windows as frames, the error function as its series,
Voigt's convolution as a sum, Pearson's norm as its closed form.
"""

from __future__ import annotations

from lumenframe.plans import view_queries  # noqa: F401  adds the shapes of kernels
from lumenframe.plans.queries import _SMALL, QUERIES, W, query, r6

_HALF, _MOST, _LEAST = _SMALL["half_window"], _SMALL["max_half_window"], _SMALL["min_half_window"]


def _near(of: str, value: str, half: int) -> str:
    """The least or greatest of the neighbours; repeated ends change neither."""
    return f"{of}({value}) OVER ({W} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"


def _mean(value: str, half: int) -> str:
    """The mean of the neighbours; the ends repeat. The rows have e0 and e1, the places before and after i."""
    whole = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    ends = f"greatest({half} - e0, 0) * first_value({value}) {whole} + greatest({half} - e1, 0) * last_value({value}) {whole}"
    return f"({_near('sum', value, half)} + {ends}) / {2 * half + 1}"


#: The points, with the number of places before and after each.
_ROWS = "SELECT key, i, y, i AS e0, count(*) OVER (PARTITION BY key) - 1 - i AS e1 FROM pts"


def _chain(*steps: str) -> str:
    """Each step is a SELECT over {from}; the last gives key, i, y and z."""
    ctes = [f"s0 AS ({_ROWS})"] + [f"s{k} AS ({s.replace('{from}', f's{k - 1}')})" for k, s in enumerate(steps, 1)]
    return f"WITH {', '.join(ctes)} SELECT key, i, round(z, 6) + 0.0 AS baseline, round(y - z, 6) + 0.0 AS corrected FROM s{len(steps)}"


_ERODED = f"SELECT *, {_near('min', 'y', _HALF)} AS e FROM {{from}}"
_OPENED = f"SELECT *, {_near('max', 'e', _HALF)} AS o FROM {{from}}"


def _snip(h: int, of: str) -> str:
    return f"SELECT key, i, y, e0, e1, CASE WHEN e0 >= {h} AND e1 >= {h} THEN least({of}, (lag({of}, {h}) OVER ({W}) + lead({of}, {h}) OVER ({W})) / 2) ELSE {of} END AS z FROM {{from}}"


def _swima() -> list[str]:
    """Wider and wider means until the area hardly changes; a spectrum that is done stays as it is."""
    steps = ["SELECT *, y AS z, CAST(NULL AS DOUBLE) AS area, false AS done FROM {from}"]
    for h in range(_LEAST, _MOST + 1):
        steps += [
            f"SELECT * REPLACE (CASE WHEN done THEN z ELSE least(z, {_mean('z', h)}) END AS z) FROM {{from}}",
            "SELECT *, sum(y - z) OVER (PARTITION BY key) AS now FROM {from}",
            "SELECT * EXCLUDE (now) REPLACE (done OR coalesce(abs(now - area) < 1e-4 * greatest(abs(area), 1e-12), false) AS done, now AS area) FROM {from}",
        ]
    return steps


_BASELINES = {
    "top_hat": _chain(_ERODED, _OPENED, "SELECT *, o AS z FROM {from}"),
    "morphological": _chain(_ERODED, _OPENED, f"SELECT *, least(o, ({_near('max', 'o', _HALF)} + {_near('min', 'o', _HALF)}) / 2) AS z FROM {{from}}"),
    "rolling_ball": _chain(_ERODED, _OPENED, f"SELECT *, {_mean('o', _HALF)} AS z FROM {{from}}"),
    "mwmv": _chain(_ERODED, f"SELECT *, {_mean('e', _HALF)} AS z FROM {{from}}"),
    "snip": _chain(*(_snip(h, "y" if h == _MOST else "z") for h in range(_MOST, 0, -1))),
    "swima": _chain(*_swima()),
    "noise_median": f"""
WITH p AS ({_ROWS}), o AS (SELECT unnest(range(-{_HALF}, {_HALF + 1})) AS o),
m AS (SELECT a.key, a.i, any_value(a.y) AS y, any_value(a.e0) AS e0, any_value(a.e1) AS e1, median(b.y) AS m FROM p a, o JOIN p b ON b.key = a.key AND b.i = greatest(0, least(a.e0 + a.e1, a.i + o.o)) GROUP BY a.key, a.i),
z AS (SELECT a.key, a.i, any_value(a.y) AS y, sum(b.m * exp(-power(o.o * 2.5 / {_HALF}, 2) / 2)) / sum(exp(-power(o.o * 2.5 / {_HALF}, 2) / 2)) AS z FROM m a, o JOIN m b ON b.key = a.key AND b.i = greatest(0, least(a.e0 + a.e1, a.i + o.o)) GROUP BY a.key, a.i)
SELECT key, i, round(z, 6) + 0.0 AS baseline, round(y - z, 6) + 0.0 AS corrected FROM z""",
    "poly": _chain(
        "SELECT *, i - (e0 + e1) / 2.0::DOUBLE AS u FROM {from}",
        "SELECT *, u * u - avg(u * u) OVER (PARTITION BY key) AS q FROM {from}",
        "SELECT *, avg(y) OVER w + u * (sum(u * y) OVER w) / (sum(u * u) OVER w) + q * (sum(q * y) OVER w) / (sum(q * q) OVER w) AS z FROM {from} WINDOW w AS (PARTITION BY key)",
    ),
}

#: The line that the queries draw: height, place, half width; a left half width for split shapes.
_A, _X0, _DX, _LEFT = 2.0, 900.0, 40.0, 60.0
_U = f"(x - {_X0})"


def _sigma(half: float | str) -> str:
    return f"({half} / sqrt(2 * ln(2)))"


def _erf(z: str) -> str:
    """exp(-z^2) times the sum of z^(2n + 1) / gamma(n + 3/2), whose terms all have one sign."""
    terms = f"list_sum([exp((2 * n + 1) * ln(abs({z})) - {z} * {z} - lgamma(n + 1.5)) FOR n IN range(200)])"
    return f"(CASE WHEN {z} = 0 THEN 0 WHEN abs({z}) > 6 THEN sign({z}) ELSE sign({z}) * {terms} END)"


def _voigt(half: float, gamma: float) -> str:
    """Gaussian and Lorentzian, folded by the trapezium rule with steps far under gamma, over its value in the middle."""
    fold = lambda u: f"list_sum([exp(-t * t / (2 * {_sigma(half)} * {_sigma(half)})) / (({u} - t) * ({u} - t) + {gamma * gamma}) FOR t IN range(-600, 601)])"
    return f"({_A} * {fold(_U)} / {fold('0.0')})"


def _pearson4(dx: float, skew: float) -> str:
    """At the exponent 3/2 the norm is (1 + skew^2) / cosh(pi skew / 2)."""
    norm = f"(1 + {skew * skew}) / ((exp(pi() * {skew} / 2) + exp(-pi() * {skew} / 2)) / 2)"
    return f"({_A} * {norm} * power(1 + power({_U} / {dx}, 2), -1.5) * exp(-{skew} * atan({_U} / {dx})))"


_SKEWED = f"{_U} / ({_sigma(_DX)} * sqrt(2))"
_SHAPES = {
    "skewed_gaussian": f"{_A} * exp(-ln(2) * power({_U} / {_DX}, 2)) * (1 + {_erf(f'(0.8 * {_SKEWED})')})",
    "voigt": _voigt(_DX, 15.0),
    "split_voigt": f"CASE WHEN x < {_X0} THEN {_voigt(_LEFT, 15.0)} ELSE {_voigt(_DX, 15.0)} END",
    "skewed_voigt": f"{_voigt(_DX, 15.0)} * (1 + {_erf(f'(0.5 * {_SKEWED})')})",
    "pearson4": _pearson4(_DX, 0.4),
    "split_pearson4": f"CASE WHEN x < {_X0} THEN {_pearson4(_LEFT, 0.4)} ELSE {_pearson4(_DX, 0.4)} END",
}

for _name, _sql in _BASELINES.items():
    query(f"baseline_{_name}", _sql)(lambda s, d, f=QUERIES[f"baseline_{_name}"]: f(s, d).select("key", "i", r6("baseline", "baseline"), r6("corrected", "corrected")))
for _name, _sql in _SHAPES.items():
    query(f"shape_{_name}", f"WITH axis AS (SELECT x, round({_sql}, 6) + 0.0 AS v FROM (SELECT DISTINCT x FROM pts)) SELECT key, i, v FROM pts JOIN axis USING (x)")(
        lambda s, d, f=QUERIES[f"shape_{_name}"]: f(s, d).select("key", "i", r6("v", "v"))
    )
