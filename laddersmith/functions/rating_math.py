"""Rating formulas as SQL expressions: the same text runs in Spark and in DuckDB."""

from __future__ import annotations

import math

# Coefficients of the approximation of the normal distribution function.
CDF_NUM = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
CDF_DEN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def normal_cdf(x: str) -> str:
    """Standard normal distribution function (Hart's rational approximation), about 1e-15."""
    a = f"abs({x})"
    num, den = CDF_NUM, CDF_DEN

    def horner(cs: list[float]) -> str:
        out = f"{cs[0]:.17e}"
        for c in cs[1:]:
            out = f"({out} * {a} + {c:.17e})"
        return out

    tail = a
    tail = f"({a} + 6.5e-01)"
    for k in (4, 3, 2, 1):
        tail = f"({a} + {k}.0e0 / {tail})"
    e = f"exp(-{a} * {a} / 2.0e0)"
    low = f"(CASE WHEN {a} > 3.7e1 THEN 0.0e0 WHEN {a} < 7.07106781186547e0 THEN {e} * {horner(num)} / {horner(den)} ELSE {e} / {tail} / 2.506628274631e0 END)"
    return f"(CASE WHEN {x} > 0 THEN 1.0e0 - {low} ELSE {low} END)"


def phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def elo_expected(a: str, b: str) -> str:
    return f"(1.0e0 / (1.0e0 + power(10.0e0, (({b}) - ({a})) / 4.0e2)))"


def goal_factor(margin: str) -> str:
    return f"(CASE WHEN {margin} <= 1 THEN 1.0e0 WHEN {margin} = 2 THEN 1.5e0 ELSE (1.1e1 + {margin}) / 8.0e0 END)"


def logistic(d: str) -> str:
    return f"(1.0e0 / (1.0e0 + exp(-({d}))))"


def davidson(d: str, nu: float) -> tuple[str, str, str]:
    """Win, loss and draw of the Davidson model."""
    z = f"(1.0e0 + exp({d}) + {nu:.17e})"
    return f"(exp({d}) / {z})", f"(1.0e0 / {z})", f"({nu:.17e} / {z})"


def game_weight(margin: str, weeks: str, decay: float) -> str:
    return f"((1.0e0 + ln(1.0e0 + abs({margin}))) * power({decay:.17e}, {weeks}))"


def margin_likelihood(d: str, m: str, sigma: float) -> str:
    s = max(sigma, 1e-4)
    return f"(-0.5e0 * ln({s * s:.17e}) - (({d}) - ({m})) * (({d}) - ({m})) / {2 * s * s:.17e})"


def clamp(p: str) -> str:
    return f"least(greatest({p}, 1.0e-12), 1.0e0 - 1.0e-12)"


def sigma_eff(sigma: float, va: str, vb: str) -> str:
    return f"sqrt(greatest({sigma * sigma:.17e} + ({va}) + ({vb}), 1.0e-8))"


def player_sigma(c: str) -> str:
    return f"greatest(1.0e0 / sqrt(1.0e0 + {c}), 1.0e-8)"


def display(theta: str, center: float = 1000.0, spread: float = 200.0) -> str:
    return f"({center:.17e} + {spread:.17e} * ({theta}))"
