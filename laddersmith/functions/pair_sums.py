"""Sums over all pairs in less than all pairs: sum over j of Phi((x_i - x_j) / sqrt(s^2 + v_i + v_j)).

The normal curve is smooth on the scale s, so it is its own interpolant at Chebyshev points of skill and of variance. Every source adds its weights
to the points (moments), the curve is evaluated between points alone, and each target reads its sum off the points. The number of points
follows from the range of the skills over s and the error wanted, not from the number of players: moments are sums, so they add up over partitions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from laddersmith.functions.normal import cdf

#: Error of a mean over pairs; the bounds below are those of Chebyshev interpolation of an analytic function on an ellipse around its interval.
ERROR = 1e-11


def _points(bound, rhos) -> int:
    """Points by which the error, 4 * bound * rho^-n / (rho - 1), is small enough, for the best of the ellipses."""
    return max(1, math.ceil(min((math.log(4 / (ERROR * (r - 1))) + bound(r)) / math.log(r) for r in rhos)))


def _chebyshev(x: np.ndarray, n: int) -> np.ndarray:
    """T_0 .. T_(n-1) of x in [-1, 1], a column for each."""
    out = np.empty((len(x), n))
    out[:, 0] = 1
    if n > 1:
        out[:, 1] = x
    for k in range(2, n):
        out[:, k] = 2 * x * out[:, k - 1] - out[:, k - 2]
    return out


@dataclass
class _Axis:
    low: float
    high: float
    n: int

    def __post_init__(self):
        t = np.cos((np.arange(self.n) + 0.5) * np.pi / self.n)
        self.at = (self.low + self.high) / 2 + (self.high - self.low) / 2 * t
        # from values at the points to coefficients
        self.to_coefficients = _chebyshev(t, self.n).T * (np.where(np.arange(self.n) == 0, 1.0, 2.0) / self.n)[:, None]

    def basis(self, x: np.ndarray) -> np.ndarray:
        width = self.high - self.low
        return _chebyshev(np.clip((2 * x - self.low - self.high) / width, -1, 1) if width > 0 else np.zeros(len(x)), self.n)


class PairSums:
    """Points for skills and variances in the given ranges."""

    def __init__(self, low: float, high: float, least: float, most: float, sigma: float):
        self.sigma2 = sigma * sigma
        narrow = math.sqrt(max(self.sigma2 + 2 * least, 1e-8))
        half = (high - low) / 2
        # |Phi| on an ellipse grows as exp(b^2 / (2 s^2)), b its half axis across
        wide = lambda r: (half * (r - 1 / r) / 2 / narrow) ** 2 / 2
        self.x = _Axis(low, high, _points(wide, 1 + np.geomspace(1e-3, 1e3, 200)) if half > 0 else 1)
        # in the variance the curve is analytic and bounded right of 0
        c, h = max(self.sigma2 + 1.5 * least + most / 2, 1e-8), (most - least) / 2
        q = max(0.9 * c / h, 1.0001) if h > 0 else 1.0
        self.v = _Axis(least, most, _points(lambda r: math.log(2), [q + math.sqrt(q * q - 1)]) if h > 0 else 1)
        self.kept: dict = {}

    @property
    def points(self) -> int:
        return self.x.n * self.v.n

    def moments(self, x: np.ndarray, v: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
        """What sources weigh (``n``: as how many each counts), in coefficients; moments of parts add up."""
        return self.x.basis(x).T @ (self.v.basis(v) if n is None else n[:, None] * self.v.basis(v))

    def curve(self, moments: np.ndarray) -> np.ndarray:
        """The sums as a function of a target, in coefficients."""
        weights = self.x.to_coefficients.T @ moments @ self.v.to_coefficients
        apart, out = self.x.at[:, None] - self.x.at[None, :], np.zeros((self.x.n, self.v.n))
        for a in range(self.v.n):
            for b in range(self.v.n):
                out[:, a] += self._between(apart, *sorted((a, b))) @ weights[:, b]
        return self.x.to_coefficients @ out @ self.v.to_coefficients.T

    def _between(self, apart: np.ndarray, a: int, b: int) -> np.ndarray:
        if (a, b) not in self.kept:
            if len(self.kept) * apart.size > 1 << 22:
                self.kept.clear()
            self.kept[a, b] = cdf(apart / math.sqrt(max(self.sigma2 + self.v.at[a] + self.v.at[b], 1e-8)))
        return self.kept[a, b]

    def sums(self, x: np.ndarray, v: np.ndarray, curve: np.ndarray) -> np.ndarray:
        return ((self.x.basis(x) @ curve) * self.v.basis(v)).sum(axis=1)


def all_pairs(x: np.ndarray, v: np.ndarray, sigma: float, n: np.ndarray | None = None) -> np.ndarray:
    """The same by its definition, in blocks."""
    out = np.empty(len(x))
    for i in range(0, len(x), 256):
        gap = x[i : i + 256, None] - x[None, :]
        out[i : i + 256] = cdf(gap / np.sqrt(np.maximum(sigma**2 + v[i : i + 256, None] + v[None, :], 1e-8))) @ (np.ones(len(x)) if n is None else n)
    return out


class Standing:
    """Sums over all pairs of one set of players that changes little by little: the points stay while the players' ranges do."""

    def __init__(self, sigma: float):
        self.sigma, self.key, self.fast = sigma, None, None

    def sums(self, x: np.ndarray, v: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
        step = max(self.sigma, 1e-3) * 2
        key = (math.floor(x.min() / step) * step, math.ceil(x.max() / step) * step, math.floor(v.min() * 8) / 8, math.ceil(v.max() * 8) / 8)
        if key != self.key:
            self.key, self.fast = key, PairSums(*key, self.sigma)
        if self.fast.points >= len(x):  # so few that every pair is less work
            return all_pairs(x, v, self.sigma, n)
        return self.fast.sums(x, v, self.fast.curve(self.fast.moments(x, v, n)))
