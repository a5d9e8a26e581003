"""Kernels of one spectrum: amplitudes by frequency, and peaks by height, distance and width."""

from __future__ import annotations

import numpy as np


def amplitudes(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and amplitudes over n of the real Fourier transform; an uneven axis is made even by straight lines first."""
    n = len(y)
    if n < 2:
        return np.zeros(n), np.abs(y).astype(float)
    steps = np.diff(x)
    if (np.abs(steps - steps[0]) > abs(steps[0]) / 1000).any():
        y = np.interp(np.linspace(x[0], x[-1], n), x, y)
    return np.fft.rfftfreq(n, (x[-1] - x[0]) / (n - 1)), np.abs(np.fft.rfft(y)) / n


def local_maxima(y: np.ndarray) -> np.ndarray:
    """Places higher than both neighbours; of a level top its middle, the ends excluded."""
    if len(y) < 3:
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
    ends = np.append(starts[1:], len(y)) - 1
    level = y[starts]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return (starts[top] + ends[top]) // 2


def _far_apart(at: np.ndarray, height: np.ndarray, distance: float) -> np.ndarray:
    """The highest peaks first; each removes the lower ones nearer than the distance."""
    keep = np.ones(len(at), bool)
    for k in np.argsort(height, kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(at - at[k]) < np.ceil(distance)
            near[k] = False
            keep &= ~near
    return at[keep]


def width_of(y: np.ndarray, k: int) -> float:
    """Width in points of the peak at k, halfway down its prominence."""
    higher_left, higher_right = np.flatnonzero(y[:k] > y[k]), np.flatnonzero(y[k + 1 :] > y[k])
    left = higher_left[-1] + 1 if len(higher_left) else 0
    right = k + 1 + higher_right[0] if len(higher_right) else len(y)
    level = y[k] - (y[k] - max(y[left : k + 1].min(), y[k:right].min())) / 2
    below_left, below_right = np.flatnonzero(y[left : k + 1] <= level), np.flatnonzero(y[k:right] <= level)
    a, b = float(left), float(right - 1)
    if len(below_left):
        i = left + below_left[-1]
        a = i + (level - y[i]) / (y[i + 1] - y[i]) if y[i] < level else float(i)
    if len(below_right):
        i = k + below_right[0]
        b = i - (level - y[i]) / (y[i - 1] - y[i]) if y[i] < level else float(i)
    return b - a


def find_peaks(y: np.ndarray, height: tuple[float, float] = (-np.inf, np.inf), distance: float = 1.0, width: tuple[float, float] = (0.0, np.inf)) -> np.ndarray:
    """Places of local maxima within the bounds of height, apart by the distance at least, within the bounds of width; in that order."""
    at = local_maxima(y)
    at = at[(y[at] >= height[0]) & (y[at] <= height[1])]
    at = _far_apart(at, y[at], distance)
    return np.array([k for k in at if width[0] <= width_of(y, int(k)) <= width[1]], np.int64)
