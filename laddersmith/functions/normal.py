"""The normal distribution on arrays."""

from __future__ import annotations

import numpy as np

from laddersmith.functions.rating_math import CDF_DEN, CDF_NUM


def cdf(x: np.ndarray) -> np.ndarray:
    """Standard normal distribution function, by the approximation of rating_math."""
    a = np.abs(np.asarray(x, float))
    near = np.minimum(a, 7.07106781186547)
    num, den = np.full(a.shape, CDF_NUM[0]), np.full(a.shape, CDF_DEN[0])
    for c in CDF_NUM[1:]:
        num = num * near + c
    for c in CDF_DEN[1:]:
        den = den * near + c
    e = np.exp(-a * a / 2)
    low = e * num / den
    far = a > 7.07106781186547
    if far.any():
        t = a[far] + 0.65
        for k in (4, 3, 2, 1):
            t = a[far] + k / t
        low[far] = e[far] / t / 2.506628274631
    return np.where(x > 0, 1 - low, low)
