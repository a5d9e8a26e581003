"""Peak shapes as column expressions: a is the height, x0 the place, dx the half width at half height."""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = log(2.0)


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def _side(x: Column, x0, dx, dx_left) -> Column:
    return F.when(x < _c(x0), _c(dx_left)).otherwise(_c(dx))


def gaussian(x, a, x0, dx) -> Column:
    u = (x - _c(x0)) / _c(dx)
    return _c(a) * F.exp(-LN2 * u * u)


def split_gaussian(x, a, x0, dx, dx_left) -> Column:
    return gaussian(x, a, x0, _side(x, x0, dx, dx_left))


def lorentzian(x, a, x0, dx) -> Column:
    u = (x - _c(x0)) / _c(dx)
    return _c(a) / (1 + u * u)


def split_lorentzian(x, a, x0, dx, dx_left) -> Column:
    return lorentzian(x, a, x0, _side(x, x0, dx, dx_left))


def pseudo_voigt(x, a, x0, dx, l_ratio) -> Column:
    return _c(l_ratio) * lorentzian(x, a, x0, dx) + (1 - _c(l_ratio)) * gaussian(x, a, x0, dx)


def split_pseudo_voigt(x, a, x0, dx, dx_left, l_ratio) -> Column:
    return pseudo_voigt(x, a, x0, _side(x, x0, dx, dx_left), l_ratio)


def pearson7(x, a, x0, dx, expon) -> Column:
    m = F.when(_c(expon) == 0, F.lit(0.1)).otherwise(_c(expon))
    u = (x - _c(x0)) / _c(dx)
    return _c(a) * F.pow(1 + u * u * (F.pow(F.lit(2.0), 1 / m) - 1), -m)


def split_pearson7(x, a, x0, dx, dx_left, expon) -> Column:
    return pearson7(x, a, x0, _side(x, x0, dx, dx_left), expon)


SHAPES = {"Gaussian": gaussian, "Split Gaussian": split_gaussian, "Lorentzian": lorentzian, "Split Lorentzian": split_lorentzian, "Pseudo Voigt": pseudo_voigt, "Split Pseudo Voigt": split_pseudo_voigt, "Pearson7": pearson7, "Split Pearson7": split_pearson7}
