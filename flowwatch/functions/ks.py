"""Two-sample KS distance and p-value on small arrays inside a task."""

from __future__ import annotations

import math

import numpy as np

#: Windows that are sorted together.
_AT_ONCE = 256


def ks_distance(sorted_base: np.ndarray, values: np.ndarray) -> float:
    other = np.sort(values)
    points = np.concatenate([sorted_base, other])
    a = np.searchsorted(sorted_base, points, side="right") / len(sorted_base)
    b = np.searchsorted(other, points, side="right") / len(other)
    return float(np.abs(a - b).max())


def ks_p_values(distances: np.ndarray, n: int, m: int) -> np.ndarray:
    """Asymptotic p-values of distances between samples of n and m values."""
    e = n * m / (n + m)
    lam = (math.sqrt(e) + 0.12 + 0.11 / math.sqrt(e)) * np.asarray(distances, dtype=float)
    total = np.zeros(len(lam))
    for k in range(1, 101):
        total += (2.0 if k % 2 else -2.0) * np.exp(-2.0 * (k * lam) ** 2)
    return np.where(lam < 0.3, 1.0, np.clip(total, 0.0, 1.0))


def ks_p_value(distance: float, n: int, m: int) -> float:
    return float(ks_p_values(np.array([distance]), n, m)[0])


def window_distances(codes: np.ndarray, upto: np.ndarray, size: int, stride: int) -> np.ndarray:
    """KS distance to the baseline of the windows of ``size`` codes that begin at multiples of ``stride``.

    A code is twice the number of distinct baseline values below a value, plus one if the value is among them; ``upto``
    counts the baseline up to each distinct value. The largest gap lies at the last of equal codes, or just below the first.
    """
    every = np.arange(2 * len(upto))  # of every code, the baseline's share up to it and below it
    high, low = upto[np.minimum((every + 1) // 2, len(upto) - 1)] / upto[-1], upto[every // 2] / upto[-1]
    views = np.lib.stride_tricks.sliding_window_view(codes.astype(np.int32), size)[::stride]
    out, ends, starts = np.zeros(len(views)), np.arange(1, size + 1) / size, np.arange(size) / size
    for a in range(0, len(views), _AT_ONCE):
        s = np.sort(views[a:a + _AT_ONCE], axis=1)
        other = s[:, 1:] != s[:, :-1]
        gaps = []
        for share, place, kept in ((high, ends, np.s_[:, :-1]), (low, starts, np.s_[:, 1:])):
            gap = np.take(share, s, mode="clip")
            gap -= place
            np.abs(gap, out=gap)
            gap[kept] *= other
            gaps.append(gap.max(axis=1))
        out[a:a + _AT_ONCE] = np.maximum(*gaps)
    return out
