"""Where to look next in a search: tree-structured Parzen estimators (Bergstra et al., 2011).

Trials are split into the best few and the rest; each parameter has a density of either, a mixture of bells at the values tried and one over
the whole range. Of some draws from the density of the best, the one that is likeliest there against the rest is taken.
Trials of the same batch, whose results are still out, count among the rest, so that a batch spreads.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

#: Trials drawn at random first; draws of which one is taken; the best trials are a tenth, this many at most.
STARTUP, DRAWS, BEST = 10, 24, 25


class Bells:
    """A density on [a, b]: bells at the values, as wide as the way to the next, and one over all."""

    def __init__(self, values: list[float], a: float, b: float):
        self.a, self.b, width = a, b, b - a
        at = sorted([*values, (a + b) / 2])
        least = width / min(100, 1 + len(at))
        gaps = [max(x - lo, hi - x) for lo, x, hi in zip([a, *at], at, [*at[1:], b], strict=False)]
        self.bells = [(x, min(max(g, least), width)) for x, g in zip(at, gaps, strict=True)]
        middle = at.index((a + b) / 2)
        self.bells[middle] = ((a + b) / 2, width)
        self.inside = [0.5 * (math.erf((b - m) / s / math.sqrt(2)) - math.erf((a - m) / s / math.sqrt(2))) for m, s in self.bells]

    def draw(self, rng: random.Random) -> float:
        m, s = rng.choice(self.bells)
        while True:
            x = rng.gauss(m, s)
            if self.a <= x <= self.b:
                return x

    def log(self, x: float) -> float:
        return math.log(sum(math.exp(-0.5 * ((x - m) / s) ** 2) / (s * i) for (m, s), i in zip(self.bells, self.inside, strict=True)) / len(self.bells) / math.sqrt(2 * math.pi) + 1e-300)


class Choices:
    """Shares of choices, each counted once besides."""

    def __init__(self, values: list, choices: list):
        self.choices, self.shares = choices, [1 + sum(v == c for v in values) for c in choices]

    def draw(self, rng: random.Random):
        return rng.choices(self.choices, self.shares)[0]

    def log(self, x) -> float:
        return math.log(self.shares[self.choices.index(x)] / sum(self.shares))


def propose(rng: random.Random, spec: dict, done: list[tuple[dict, float]], waiting: list[dict], sample: Callable[[random.Random, dict], object]) -> dict:
    """The next trial's parameters. ``done``: (parameters, objective, less is better); ``waiting``: parameters whose results are out; ``sample`` draws one value at random."""
    if len(done) < STARTUP:
        return {k: sample(rng, s) for k, s in sorted(spec.items())}
    ranked = [p for p, _ in sorted(done, key=lambda x: x[1] if x[1] == x[1] else math.inf)]
    n = min(BEST, math.ceil(0.1 * len(ranked)))
    return {k: _next(rng, s, [p[k] for p in ranked[:n]], [p[k] for p in ranked[n:] + waiting]) for k, s in sorted(spec.items())}


def _next(rng: random.Random, spec: dict, good: list, rest: list):
    if spec.get("type") == "categorical" or "choices" in spec:
        best, others = Choices(good, spec["choices"]), Choices(rest, spec["choices"])
        return max((best.draw(rng) for _ in range(DRAWS)), key=lambda x: best.log(x) - others.log(x))
    lo, hi = spec.get("low", spec.get("min")), spec.get("high", spec.get("max"))
    if lo == hi:
        return lo
    to, back = (math.log, math.exp) if spec.get("log") else (float, float)
    best, others = (Bells([to(v) for v in x], to(lo), to(hi)) for x in (good, rest))
    x = min(max(back(max((best.draw(rng) for _ in range(DRAWS)), key=lambda x: best.log(x) - others.log(x))), lo), hi)
    if spec.get("type") == "int":
        step = spec.get("step", 1)
        return int(lo + round((x - lo) / step) * step)
    return x
