"""Sequential rating models: one state, games in time order.

Each model predicts a game before it learns from it. Models are plain Python over floats and run
inside one grouped task for each league and trial (see folds.py); the published formulas are given with each.
"""

from __future__ import annotations

import math
from array import array
from dataclasses import dataclass, field

import numpy as np

from laddersmith.functions.rating_math import phi

SQRT2PI = math.sqrt(2 * math.pi)


@dataclass(slots=True)
class Game:
    game_id: int
    day: float | None
    r1: list
    r2: list
    s1: int
    s2: int
    readable: bool = True
    outcome_only: bool = False
    tournament: bool = False
    on_court: int = 8
    teams: tuple | None = None
    #: How many players each entry of r1 and r2 stands for; none: one.
    n1: list | None = None
    n2: list | None = None
    #: Equal games that this one stands for.
    times: int = 1
    #: side() of both, where many games share them.
    side1: tuple | None = None
    side2: tuple | None = None

    def side(self, k: int) -> tuple[list, list, int]:
        """The entries of a side, the players that each stands for, and all of them."""
        known = self.side1 if k == 1 else self.side2
        if known is not None:
            return known
        r, n = (self.r1, self.n1) if k == 1 else (self.r2, self.n2)
        n = [1] * len(r) if n is None else n
        return r, n, sum(n)


def _pdf(x: float) -> float:
    return math.exp(-x * x / 2) / SQRT2PI


def _quantile(p: float) -> float:
    """Inverse of the normal distribution function, by bisection."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if phi(mid) < p else (lo, mid)
    return (lo + hi) / 2


@dataclass
class Elo:
    """Logistic expectation with base 10 and scale 400; the change is shared among a side's players."""

    initial: float = 1000.0
    k: float = 346.446
    tournament_factor: float = 1.514
    ratings: dict = field(default_factory=dict)
    #: The game that was predicted last, if nothing was learned since, and its prediction.
    asked: tuple | None = None

    def _mean(self, side: tuple) -> float:
        """Of a side as of Game.side()."""
        if not side[0]:
            return self.initial
        get, start, total = self.ratings.get, self.initial, 0.0
        for p, n in zip(side[0], side[1]):  # noqa: B905
            total += n * get(p, start)
        return total / side[2]

    def predict(self, g: Game) -> float:
        p = 1 / (1 + 10 ** ((self._mean(g.side2 or g.side(2)) - self._mean(g.side1 or g.side(1))) / 400))
        self.asked = (g, p)
        return p

    def update(self, g: Game) -> None:
        s1, s2 = (g.s1, g.s2) if g.readable else (1, 0) if g.outcome_only else (0, 0)
        if g.r1 and g.r2:
            expected = self.asked[1] if self.asked is not None and self.asked[0] is g else self.predict(g)
        else:
            expected = 0.5
        self.asked = None
        actual = 1.0 if s1 > s2 else 0.0 if s1 < s2 else 0.5
        margin = abs(s1 - s2)
        factor = 1.0 if margin <= 1 else 1.5 if margin == 2 else (11 + margin) / 8
        change = self.k * factor * (self.tournament_factor if g.tournament else 1.0) * (actual - expected)
        ratings, start = self.ratings, self.initial
        for (side, _, size), c in ((g.side1 or g.side(1), change), (g.side2 or g.side(2), -change)):
            if side:
                each = c / size
                for p in side:
                    ratings[p] = ratings.get(p, start) + each

    def expose(self, p) -> float:
        return self.ratings.get(p, self.initial)


    def lane(self, places: dict, sides: list) -> Lane:
        return EloLane(self, places, sides)


class Lane:
    """One model's state as lists by place, for streams of games: the same steps and results as the model's, without an object for each game.

    ``places``: of each player; ``sides``: (places, players each stands for, all of them), the first without players; both grow with the stream and are shared by the trials of a task."""

    def grow(self) -> None:
        """Places that have come with a side start as the model says."""

    def predict(self, a: int, b: int, court: int) -> float:
        raise NotImplementedError

    def learn(self, a: int, b: int, s1: int, s2: int, readable: bool, only: bool, tournament: bool, court: int, p: float | None) -> None:
        """``p``: what predict() has said of this game, if it was asked."""
        raise NotImplementedError

    def shown(self, k: int) -> tuple[float, float, float | None]:
        """(rating, mu, sigma) of a place."""
        raise NotImplementedError


class EloLane(Lane):
    def __init__(self, m: Elo, places: dict, sides: list):
        self.m, self.places, self.sides, self.r = m, places, sides, []

    def grow(self) -> None:
        self.r.extend([self.m.initial] * (len(self.places) - len(self.r)))

    def predict(self, a: int, b: int, court: int) -> float:
        r = self.r
        at1, n1, size1 = self.sides[a]
        at2, n2, size2 = self.sides[b]
        m1 = m2 = 0.0
        for k, n in zip(at1, n1):  # noqa: B905
            m1 += n * r[k]
        for k, n in zip(at2, n2):  # noqa: B905
            m2 += n * r[k]
        return 1 / (1 + 10 ** (((m2 / size2 if size2 else self.m.initial) - (m1 / size1 if size1 else self.m.initial)) / 400))

    def learn(self, a: int, b: int, s1: int, s2: int, readable: bool, only: bool, tournament: bool, court: int, p: float | None) -> None:
        if not readable:
            s1, s2 = (1, 0) if only else (0, 0)
        expected = (self.predict(a, b, court) if p is None else p) if a and b else 0.5
        margin = s1 - s2
        if margin > 0:
            change = 1.0 - expected
        elif margin < 0:
            change, margin = 0.0 - expected, -margin
        else:
            change = 0.5 - expected
        m, r, sides = self.m, self.r, self.sides
        change = m.k * (1.0 if margin <= 1 else 1.5 if margin == 2 else (11 + margin) / 8) * (m.tournament_factor if tournament else 1.0) * change
        if a:
            at, _, size = sides[a]
            each = change / size
            for k in at:
                r[k] += each
        if b:
            at, _, size = sides[b]
            each = -change / size
            for k in at:
                r[k] += each

    def shown(self, k: int) -> tuple[float, float, float | None]:
        return self.r[k], self.r[k], None


def _truncated(t: float, eps: float, draw: bool) -> tuple[float, float]:
    """Mean and variance corrections v and w of a truncated normal difference (Herbrich et al., 2006)."""
    if draw:
        a = abs(t)
        z = phi(eps - a) - phi(-eps - a)
        if z < 1e-300:
            return (-t - eps if t < 0 else -t + eps), 1.0
        v = (_pdf(-eps - a) - _pdf(eps - a)) / z
        w = v * v + ((eps - a) * _pdf(eps - a) + (eps + a) * _pdf(eps + a)) / z
        return (v if t >= 0 else -v), w
    x = t - eps
    z = phi(x)
    if z < 1e-300:
        return -x, 1.0
    v = _pdf(x) / z
    return v, v * (v + x)


@dataclass
class TrueSkill:
    """Two teams with partial play: small rosters are weighted up to the players on court."""

    mu: float = 1000.0
    sigma: float | None = None
    beta: float | None = None
    tau: float | None = None
    draw: float = 0.123
    ratings: dict = field(default_factory=dict)
    edge: float | None = None

    def __post_init__(self):
        self.sigma = self.mu / 3 if self.sigma is None else self.sigma
        self.beta = self._default_beta() if self.beta is None else self.beta
        self.tau = self.sigma / 100 if self.tau is None else self.tau

    def _default_beta(self) -> float:
        return self.sigma / 2

    def _get(self, p):
        return self.ratings.get(p, (self.mu, self.sigma))

    @staticmethod
    def _weight(players: int, on_court: int) -> float:
        return max(1.0, on_court / players)

    def _rate(self, winners: tuple, losers: tuple, w_win: float, w_lose: float, draw: bool) -> None:
        """``winners``, ``losers``: as of Game.side()."""
        ratings, start, tau2, beta2 = self.ratings, (self.mu, self.sigma), self.tau * self.tau, self.beta * self.beta
        both, c2, diff = [], 0.0, 0.0
        for side, w in ((winners, w_win), (losers, -w_lose)):
            for p, k in zip(side[0], side[1]):  # noqa: B905
                m, s = ratings.get(p, start)
                var = s * s + tau2
                c2 += k * w * w * (var + beta2)
                diff += k * w * m
                both.append((p, m, var, w))
        c = math.sqrt(c2)
        if self.edge is None:
            self.edge = _quantile((self.draw + 1) / 2) if self.draw > 0 else 0.0
        eps = self.edge * math.sqrt(winners[2] + losers[2]) * self.beta
        v, w_ = _truncated(diff / c, eps / c, draw)
        v, w_ = v / c, w_ / c2
        for p, m, var, w in both:
            ratings[p] = (m + w * var * v, math.sqrt(max(var * (1 - w * w * var * w_), 1e-12)))

    def update(self, g: Game) -> None:
        if not g.r1 or not g.r2:
            return
        s1, s2 = (g.s1, g.s2) if g.readable else (0, 0)
        a, b = g.side(1), g.side(2)
        w1, w2 = self._weight(a[2], g.on_court), self._weight(b[2], g.on_court)
        if s1 >= s2:
            self._rate(a, b, w1, w2, s1 == s2)
        else:
            self._rate(b, a, w2, w1, False)

    def predict(self, g: Game) -> float:
        if not g.r1 or not g.r2:
            return 0.5
        a, b = g.side(1), g.side(2)
        w1, w2 = self._weight(a[2], g.on_court), self._weight(b[2], g.on_court)
        d = w1 * self._total(a) - w2 * self._total(b)
        get, start, beta2, var = self.ratings.get, (self.mu, self.sigma), self.beta**2, 0.0
        for side, w in ((a, w1), (b, w2)):
            for p, k in zip(side[0], side[1]):  # noqa: B905
                s = get(p, start)[1]
                var += k * w * w * (beta2 + s * s)
        return phi(d / math.sqrt(var)) if var > 0 else 0.5

    def _total(self, side: tuple) -> float:
        return sum(k * self._get(p)[0] for p, k in zip(side[0], side[1], strict=True))

    def expose(self, p) -> float:
        m, s = self._get(p)
        return m - self.mu / self.sigma * s

    def lane(self, places: dict, sides: list) -> Lane:
        return TrueSkillLane(self, places, sides)


class TrueSkillLane(Lane):
    def __init__(self, m: TrueSkill, places: dict, sides: list):
        self.m, self.places, self.sides, self.mean, self.dev = m, places, sides, [], []
        self.points = isinstance(m, TrueSkillMargin)
        self.edge = _quantile((m.draw + 1) / 2) if m.draw > 0 else 0.0
        self.tau2, self.beta2 = m.tau * m.tau, m.beta * m.beta
        self.kinds: dict = {}

    def grow(self) -> None:
        more = len(self.places) - len(self.mean)
        self.mean.extend([self.m.mu] * more)
        self.dev.extend([self.m.sigma] * more)

    def _kind(self, a: int, b: int, court: int) -> tuple:
        """What two sides have throughout: (place, weight w with side 2's minus, n * w, n * w * w, w * w) of their entries that stand for n players, and the margin of a draw."""
        known = self.kinds.get((a, b, court))
        if known is None:
            (at1, n1, size1), (at2, n2, size2) = self.sides[a], self.sides[b]
            w1, w2 = self.m._weight(size1, court), self.m._weight(size2, court)
            known = self.kinds[a, b, court] = (
                [(k, w1, n * w1, n * w1 * w1, w1 * w1) for k, n in zip(at1, n1, strict=True)], [(k, -w2, -n * w2, n * w2 * w2, w2 * w2) for k, n in zip(at2, n2, strict=True)], self.edge * math.sqrt(size1 + size2) * self.m.beta,
            )
        return known

    def _rate(self, kind: tuple, sign: int, draw: bool) -> None:
        """``sign``: 1 if side 1 has won (or drawn), -1 if side 2 has."""
        one, two, eps = kind
        mean, dev, tau2, beta2, c2, diff, was = self.mean, self.dev, self.tau2, self.beta2, 0.0, 0.0, []
        # winners first, as the model has it: of a player on both sides the loser's state counts
        both = one + two if sign > 0 else two + one
        for k, sw, nw, nww, ww in both:
            s, m = dev[k], mean[k]
            v = s * s + tau2
            c2 += nww * (v + beta2)
            diff += nw * m
            was.append((k, sw, ww, v, m))
        c = math.sqrt(c2)
        v, w = _truncated(sign * diff / c, eps / c, draw)
        v, w = sign * v / c, w / c2
        for k, sw, ww, var, m in was:
            mean[k] = m + sw * var * v
            left = var * (1 - ww * var * w)
            dev[k] = math.sqrt(left if left > 1e-12 else 1e-12)

    def learn(self, a: int, b: int, s1: int, s2: int, readable: bool, only: bool, tournament: bool, court: int, p: float | None) -> None:
        if not a or not b:
            return
        kind = self.kinds.get((a, b, court)) or self._kind(a, b, court)
        if self.points:
            for _ in range(s1):
                self._rate(kind, 1, False)
            for _ in range(s2):
                self._rate(kind, -1, False)
            return
        if not readable:
            s1 = s2 = 0
        self._rate(kind, 1 if s1 >= s2 else -1, s1 == s2)

    def predict(self, a: int, b: int, court: int) -> float:
        if not a or not b:
            return 0.5
        one, two, _ = self._kind(a, b, court)
        mean, dev, beta2, d, var = self.mean, self.dev, self.beta2, 0.0, 0.0
        for k, w, nw, nww, _ in (*one, *two):
            s = dev[k]
            if self.points:
                d += nw / abs(w) * mean[k]
                var += nww * s * s
            else:
                d += nw * mean[k]
                var += nww * (beta2 + s * s)
        if self.points:
            var += 2 * court * beta2
        return phi(d / math.sqrt(var)) if var > 0 else 0.5

    def shown(self, k: int) -> tuple[float, float, float | None]:
        m, s = self.mean[k], self.dev[k]
        return m - self.m.mu / self.m.sigma * s, m, s


@dataclass
class TrueSkillMargin(TrueSkill):
    """Each point is a win: team 1's points first, then team 2's."""

    def _default_beta(self) -> float:
        return self.sigma / 2 * math.sqrt(5)

    def update(self, g: Game) -> None:
        if not g.r1 or not g.r2:
            return
        a, b = g.side(1), g.side(2)
        w1, w2 = self._weight(a[2], g.on_court), self._weight(b[2], g.on_court)
        for _ in range(max(0, g.s1)):
            self._rate(a, b, w1, w2, False)
        for _ in range(max(0, g.s2)):
            self._rate(b, a, w2, w1, False)

    def predict(self, g: Game) -> float:
        if not g.r1 or not g.r2:
            return 0.5
        a, b = g.side(1), g.side(2)
        d = self._total(a) - self._total(b)
        w1, w2 = self._weight(a[2], g.on_court), self._weight(b[2], g.on_court)
        var = 2 * g.on_court * self.beta**2 + sum(k * (w * self._get(p)[1]) ** 2 for side, w in ((a, w1), (b, w2)) for p, k in zip(side[0], side[1], strict=True))
        return phi(d / math.sqrt(var)) if var > 0 else 0.5


@dataclass
class ThroughTime:
    """Skill through time: Gaussian skills that drift by gamma a day (Dangauthier et al., 2007).

    update() is the filtering pass. converge() sweeps forward and backward over all games and
    leaves learning curves. Large rosters are weighted down to the players on court.
    """

    mu: float = 25.0
    sigma: float = 25.0 / 3
    beta: float = 5.0
    gamma: float = 0.5
    p_draw: float = 0.06
    iterations: int = 10
    min_new_games: int = 10
    compat_inverted_result: bool = False
    priors: dict = field(default_factory=dict)
    ratings: dict = field(default_factory=dict)
    last_day: dict = field(default_factory=dict)
    #: Of each game its day and its form; a form is all else that a convergence reads of it, once for all games that share it (None: a side without players).
    days: array = field(default_factory=lambda: array("d"))
    forms: array = field(default_factory=lambda: array("q"))
    known: list = field(default_factory=list)
    book: dict = field(default_factory=dict)
    #: Where each player's curve stands in days, means and deviations.
    spans: dict = field(default_factory=dict)
    points: tuple = ()
    fitted: int = 0
    settled: int = 0
    counted: int = 0
    count: int = 0
    clock: float | None = None
    _quantile: float | None = None

    def _prior(self, p):
        m, s = self.priors.get(p, (self.mu, self.sigma))
        return m, max(s, 1e-8)

    def _get(self, p):
        if self.clock is not None and self.spans:
            return self.rating_at(p, self.clock)
        if p in self.spans:
            k = self.spans[p][1] - 1
            return float(self.points[1][k]), float(self.points[2][k])
        return self.ratings.get(p, self._prior(p))

    def rating_at(self, p, day: float) -> tuple[float, float]:
        """The last point of the curve at or before ``day``, else the filtered rating, else the prior."""
        lo, hi = self.spans.get(p, (0, 0))
        k = lo + int(np.searchsorted(self.points[0][lo:hi], day, side="right")) if hi > lo else lo
        best = (float(self.points[1][k - 1]), float(self.points[2][k - 1])) if k > lo else None
        return best or self.ratings.get(p) or self._prior(p)

    @staticmethod
    def _weight(players: int, on_court: int) -> float:
        n = max(1, on_court)
        return n / players if players > n else 1.0

    def _sides(self, g: Game) -> tuple[tuple, tuple, bool, dict]:
        """Winners, losers (side 1 and 2 of a draw; as of Game.side()), whether it is one, and the weights of both."""
        s1, s2 = max(0, g.s1), max(0, g.s2)
        if self.compat_inverted_result:
            s1, s2 = s2, s1
        win, lose = (g.side(1), g.side(2)) if s1 >= s2 else (g.side(2), g.side(1))
        return win, lose, s1 == s2, {1: self._weight(win[2], g.on_court), -1: self._weight(lose[2], g.on_court)}

    def _margin(self, n: int) -> float:
        """The draw margin of a game of ``n`` players."""
        if self.p_draw <= 0:
            return 0.0
        if self._quantile is None:
            self._quantile = _quantile((self.p_draw + 1) / 2)
        return self._quantile * math.sqrt(n) * self.beta

    def _places(self, win: tuple, lose: tuple, ws: dict) -> tuple[list, list]:
        """The players of a game, each once, and for each place of both sides, winners first: its player, weight w (losers' with minus), w * w, and both times the players that it stands for."""
        own = list(dict.fromkeys([*win[0], *lose[0]]))
        at = {p: k for k, p in enumerate(own)}
        return own, [(at[p], s * ws[s], ws[s] * ws[s], n * s * ws[s], n * ws[s] * ws[s]) for s, side in ((1, win), (-1, lose)) for p, n in zip(side[0], side[1], strict=True)]

    def _messages(self, m: list, var: list, places: list, eps: float, draw: bool) -> tuple[list, list]:
        """Messages (precision, precision * mean) of one game to its players, given their means and variances without it.

        ``places`` as of _places(). Of a player on both sides the losing one counts. Plain floats: a game's few numbers are too few for arrays.
        """
        beta2, c2, diff = self.beta * self.beta, 0.0, 0.0
        for j, _, _, nw, nww in places:
            c2 += nww * (var[j] + beta2)
            diff += nw * m[j]
        c = math.sqrt(c2)
        v, k = _truncated(diff / c, eps / c, draw)
        v /= c
        k /= c2
        pi, tau = [0.0] * len(m), [0.0] * len(m)
        for j, w, ww, _, _ in places:
            x, mean = var[j], m[j]
            left = x * (1 - ww * x * k)
            if left < 1e-12:
                left = 1e-12
            pi[j] = 1 / left - 1 / x
            tau[j] = (mean + w * x * v) / left - mean / x
        return pi, tau

    def update(self, g: Game) -> None:
        day = g.day if g.day is not None else float(self.count)
        self.count += 1
        self.days.append(day)
        if not g.r1 or not g.r2:
            self.forms.append(-1)
            return
        form = self._form(g)
        self.forms.append(form)
        own, places, margin, draw = self.known[form][:4]
        ratings, last, g2, ms, vs = self.ratings, self.last_day, self.gamma * self.gamma, [], []
        for p in own:
            m, s = ratings.get(p) or self._prior(p)
            ms.append(m)
            vs.append(max(s * s + max(0.0, day - last.get(p, day)) * g2, 1e-16))
        pi, tau = self._messages(ms, vs, places, margin, draw)
        for p, m, v, x, y in zip(own, ms, vs, pi, tau):  # noqa: B905
            prec = 1 / v + x
            ratings[p] = ((m / v + y) / prec, math.sqrt(1 / prec))
            last[p] = day

    def _form(self, g: Game) -> int:
        """The number of a game's form. Games are alike by the lists that they share, which a form holds on to."""
        s1, s2 = max(0, g.s1), max(0, g.s2)
        key = (id(g.r1), id(g.n1), id(g.r2), id(g.n2), (s1 > s2) - (s1 < s2), g.on_court)
        k = self.book.get(key)
        if k is None:
            k = self.book[key] = len(self.known)
            win, lose, draw, ws = self._sides(g)
            own, places = self._places(win, lose, ws)
            self.known.append((own, places, self._margin(win[2] + lose[2]), draw, (g.r1, g.n1, g.r2, g.n2)))
        return k

    @property
    def curves(self) -> dict:
        """Every player's (day, mean, deviation), all at once."""
        return {p: list(zip(*(x[lo:hi].tolist() for x in self.points), strict=True)) for p, (lo, hi) in self.spans.items()}

    def settle(self, n: int) -> None:
        """Converge on the first ``n`` games, unless that was the last thing settled."""
        if n != self.settled:
            self.settled = n
            self.converge(force=True, first=n)

    def converge(self, force: bool = False, first: int | None = None) -> None:
        """Forward and backward sweeps; skipped while fewer than ``min_new_games`` came since the last. ``first``: only so many games count."""
        form = np.array(self.forms, np.int64)[:first]
        told = len(form)
        rated = np.flatnonzero(form >= 0)
        if not len(rated) or not force and told - self.counted < self.min_new_games:
            return
        day = np.array(self.days)[rated]
        rated = rated[np.argsort(day, kind="stable")]
        day, form = np.sort(day, kind="stable"), form[rated]
        # a slot is a player in a game; messages are precisions and precisions times means
        players: dict = {}
        sides = [None] * len(self.known)
        for k in form[np.sort(np.unique(form, return_index=True)[1])].tolist():
            own, places, margin, draw = self.known[k][:4]
            sides[k] = ([players.setdefault(p, len(players)) for p in own], places, margin, draw)
        offs = np.concatenate([[0], np.cumsum(np.array([0 if x is None else len(x[0]) for x in sides])[form])])
        n_slots, forms, days, ends = int(offs[-1]), form.tolist(), day.tolist(), offs.tolist()
        prior = np.array([self._prior(p) for p in players])
        start = (1 / prior[:, 1] ** 2, prior[:, 0] / prior[:, 1] ** 2)
        # what reaches each slot from the games before it and after it; a way back leaves the game's own messages for the way ahead, which reads no others
        come = {ahead: (array("d", bytes(8 * n_slots)), array("d", bytes(8 * n_slots))) for ahead in (True, False)}
        g2 = self.gamma**2

        # the day of each player's first and last game: what there is at the ends hasn't drifted
        met: dict = {True: [0.0] * len(players), False: [0.0] * len(players)}
        for i, k in enumerate(forms):
            for x in sides[k][0]:
                met[False][x] = days[i]
        for i in range(len(forms) - 1, -1, -1):
            for x in sides[forms[i]][0]:
                met[True][x] = days[i]
        beta2, sqrt, exp, erfc, half = self.beta * self.beta, math.sqrt, math.exp, math.erfc, math.sqrt(0.5)

        def sweep(ahead: bool, learn: bool) -> None:
            run_pi, run_tau = (x.tolist() if ahead else [0.0] * len(players) for x in start)
            seen = met[ahead].copy()
            (mine_pi, mine_tau), (other_pi, other_tau) = come[ahead], come[not ahead]
            for i in range(len(forms)) if ahead else range(len(forms) - 1, -1, -1):
                k, day_, (who, places, margin, draw) = ends[i], days[i], sides[forms[i]]
                got = []
                for x in who:
                    pi, tau = run_pi[x], run_tau[x]
                    if seen[x] != day_:
                        if pi > 0:
                            wide = 1 / pi + abs(day_ - seen[x]) * g2
                            tau *= 1 / (pi * wide)
                            pi = 1 / wide
                        seen[x] = day_
                    if learn:
                        q = pi + other_pi[k]
                        near = tau + other_tau[k]
                        got.append((x, k, pi, tau, q, near, 1 / q, near / q))
                    else:
                        # all that is known of a slot
                        run_pi[x], run_tau[x] = pi, tau = pi + mine_pi[k], tau + mine_tau[k]
                        mine_pi[k], mine_tau[k] = pi + other_pi[k], tau + other_tau[k]
                    k += 1
                if not learn:
                    continue
                # as _messages()
                c2 = diff = 0.0
                for j, _, _, nw, nww in places:
                    slot = got[j]
                    c2 += nww * (slot[6] + beta2)
                    diff += nw * slot[7]
                c = sqrt(c2)
                if draw:
                    v, w2 = _truncated(diff / c, margin / c, True)
                else:
                    t = (diff - margin) / c
                    z = 0.5 * erfc(-t * half)
                    if z < 1e-300:
                        v, w2 = -t, 1.0
                    else:
                        v = exp(-0.5 * t * t) / SQRT2PI / z
                        w2 = v * (v + t)
                v /= c
                w2 /= c2
                for j, w, ww, _, _ in places:
                    x, k, pi, tau, q, near, var, mean = got[j]
                    left = var * (1 - ww * var * w2)
                    if left < 1e-12:
                        left = 1e-12
                    mp, mt = 1 / left - q, (mean + w * var * v) / left - near
                    if not ahead:
                        other_pi[k] = mp
                        other_tau[k] = mt
                    mine_pi[k] = pi
                    mine_tau[k] = tau
                    run_pi[x] = pi + mp
                    run_tau[x] = tau + mt

        try:
            for _ in range(self.iterations):
                sweep(True, True)
                sweep(False, True)
            sweep(True, False)
        except (ZeroDivisionError, ValueError, OverflowError):
            return  # as below: nothing finite comes of it
        pi, tau = (np.frombuffer(x) for x in come.pop(True))
        come.clear()
        if not ((pi > 0) & np.isfinite(tau)).all():
            return  # keeps the ratings from before
        slots = np.concatenate([sides[k][0] for k in forms]).astype(np.int32)
        order = np.argsort(slots, kind="stable")
        np.divide(tau, pi, out=tau)
        np.sqrt(np.divide(1, pi, out=pi), out=pi)
        self.points = (np.repeat(day, np.diff(offs))[order], tau[order], pi[order])
        upto = np.concatenate([[0], np.cumsum(np.bincount(slots, minlength=len(players)))]).tolist()
        self.spans = {p: (upto[k], upto[k + 1]) for p, k in players.items()}
        self.fitted, self.counted = len(forms), told

    def predict(self, g: Game) -> float:
        if not g.r1 or not g.r2:
            return 0.5
        (m1, v1), (m2, v2) = ((sum(n * m for (m, _), n in x) / total, sum(n * s * s for (_, s), n in x) / total) for x, total in (([(self._get(p), n) for p, n in zip(r, ns, strict=True)], total) for r, ns, total in (g.side(1), g.side(2))))
        var = 2 * self.beta**2 / max(1, g.on_court) + v1 + v2
        return phi((m1 - m2) / math.sqrt(var)) if var > 0 else 0.5

    def expose(self, p) -> float:
        m, s = self._get(p)
        return (m - 3 * s) * 1000 / self.mu
