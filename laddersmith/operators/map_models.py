"""Batch maximum-a-posteriori fits of player skills.

d = mean skill of side 1 less that of side 2. The losses are smooth; a Newton method with
conjugate gradients (players number up to thousands, games are sparse) takes them to a gradient near zero.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from laddersmith.functions.normal import cdf
from laddersmith.functions.pair_sums import Standing
from laddersmith.functions.rating_math import phi
from laddersmith.operators.sequential import Game


def log_cdf(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log Phi and phi / Phi, with the asymptotic tail below -8."""
    z = np.asarray(z, float)
    far = z < -8
    p = np.where(far, 1.0, cdf(np.maximum(z, -8)))
    t = np.minimum(z, -8.0)
    tail = -0.5 * t * t - np.log(-t) - 0.5 * math.log(2 * math.pi) + np.log1p(-1 / t**2 + 3 / t**4)
    lp = np.where(far, tail, np.log(p))
    return lp, np.exp(-0.5 * z * z - 0.5 * math.log(2 * math.pi) - lp)


#: Of a pair of sides: games that count by margin won by side 1 and by side 2, their margins' sum and sum of squares, other games won by side 1 and by side 2, drawn games.
_TALLY = 7


class Grow:
    """An array that grows at its end."""

    def __init__(self, kind, *height: int):
        self.data, self.n = np.zeros((*height, 64), kind), 0

    def push(self, x) -> None:
        if self.n == self.data.shape[-1]:
            self.data = np.concatenate([self.data, np.zeros_like(self.data)], axis=-1)
        self.data[..., self.n] = x
        self.n += 1

    def view(self) -> np.ndarray:
        return self.data[..., : self.n]


class Ledger:
    """Games as arrays that grow game by game, and the sparse game-by-player matrix as a product: games refer to rosters, rosters to players.

    A side has 1 / n for each of its players, side 2 with minus. With ``replace``, a player on both sides has the second side's coefficient
    alone (a third reference takes the first one's back); else both add up. With ``merge``, equal games are one row with their number
    (times), in which ``decay``, if given, has their ages: a weight that falls by it each week.
    """

    def __init__(self, replace: bool = False, merge: bool = False, decay: float | None = None):
        self.replace, self.merge, self.decay = replace, merge, decay
        self.rows: dict[tuple, int] = {}
        self.times, self.dateless, self.faded = Grow(float), Grow(float), Grow(float)
        self.origin, self.newest = None, None
        self.count, self.size = Grow(float), 0.0
        self.players: list = []
        self.at: dict = {}
        self.sides: dict[tuple, int] = {}
        self.i1, self.i2, self.i3 = Grow(np.int64), Grow(np.int64), Grow(np.int64)
        self.s1, self.s2, self.day = Grow(float), Grow(float), Grow(float)
        self.only, self.tournament = Grow(bool), Grow(bool)
        self.srow, self.scol, self.sval = Grow(np.int64), Grow(np.int64), Grow(float)
        self.own: dict[int, set] = {}
        # a pair of sides has one difference of skills: its rows and what they add up to (_TALLY of plain games, then of tournaments)
        self.pairs: dict[tuple, int] = {}
        self.pair, self.p1, self.p2, self.p3, self.tally = Grow(np.int64), Grow(np.int64), Grow(np.int64), Grow(np.int64), Grow(float, 2 * _TALLY)
        self._side((), 1.0)

    def _side(self, side: tuple, value: float, name: tuple | None = None, counts: list | None = None) -> int:
        k = self.sides.get(name or side)
        if k is None:
            k = self.sides[name or side] = len(self.sides)
            for i, p in enumerate(side):
                if p not in self.at:
                    self.at[p] = len(self.players)
                    self.players.append(p)
                    self.count.push(1.0 if counts is None else counts[i])
                    self.size += self.count.data[self.count.n - 1]
                self.srow.push(k)
                self.scol.push(self.at[p])
                self.sval.push(value * self.count.data[self.at[p]])
            self.own[k] = set(side)
        return k

    def add(self, g: Game) -> None:
        a, b = (self._side(tuple(r), 1 / max(n, 1), None, ns) for r, ns, n in (g.side(1), g.side(2)))
        third = self.rows.get(("both", a, b)) if self.replace else 0
        if third is None:
            both = self.own[a] & self.own[b]
            third = self.rows["both", a, b] = self._side(tuple(both), 1 / g.side(1)[2], ("both", a, b)) if both else 0
        s1, s2, only, tournament = max(0, g.s1), max(0, g.s2), bool(g.outcome_only), bool(g.tournament)
        pair = self.pairs.get((a, b))
        if pair is None:
            pair = self.pairs[a, b] = self.p1.n
            for x, v in ((self.p1, a), (self.p2, b), (self.p3, third), (self.tally, 0.0)):
                x.push(v)
        t, c = self.tally.data[:, pair], _TALLY * tournament
        if s1 == s2:
            t[c + 6] += g.times
        elif only:
            t[c + (4 if s1 > s2 else 5)] += g.times
        else:
            t[c + (0 if s1 > s2 else 1)] += g.times
            t[c + 2] += g.times * (s1 - s2)
            t[c + 3] += g.times * (s1 - s2) ** 2
        key = (a, b, s1, s2, only, tournament)
        k = self.rows.get(key) if self.merge else None
        if k is None:
            k = self.rows[key] = self.i1.n
            self.i1.push(a)
            self.i2.push(b)
            self.i3.push(third)
            self.pair.push(pair)
            self.s1.push(s1)
            self.s2.push(s2)
            self.day.push(math.nan if g.day is None else g.day)
            self.only.push(only)
            self.tournament.push(tournament)
            for x in (self.times, self.dateless, self.faded):
                x.push(0.0)
        self.times.data[k] += g.times
        if g.day is None:
            self.dateless.data[k] += g.times
            return
        self.newest = g.day if self.newest is None else max(self.newest, g.day)
        if self.decay is not None:
            if self.origin is None or abs((g.day - self.origin) / 7 * math.log(self.decay)) > 200 and g.day > self.origin:
                self.faded.view()[:] *= self.decay ** ((g.day - self.origin) / 7) if self.origin is not None else 1.0
                self.origin = g.day
            self.faded.data[k] += g.times * self.decay ** ((self.origin - g.day) / 7)

    def aged(self) -> np.ndarray:
        """The number of equal games, each weighted by ``decay`` for the weeks from it to the newest."""
        if self.origin is None:
            return self.dateless.view()
        return self.dateless.view() + self.faded.view() * self.decay ** ((self.newest - self.origin) / 7)

    def __len__(self) -> int:
        return self.i1.n

    def tallies(self, tournament: float = 1.0) -> np.ndarray:
        """Rows of _TALLY, a column for each pair; games of tournaments count as so many."""
        t = self.tally.view()
        return t[:_TALLY] + tournament * t[_TALLY:]

    def dot(self, theta: np.ndarray) -> np.ndarray:
        u = np.bincount(self.srow.view(), self.sval.view() * theta[self.scol.view()], len(self.sides))
        d = u[self.i1.view()] - u[self.i2.view()]
        return d - u[self.i3.view()] if self.replace else d

    def back(self, g: np.ndarray) -> np.ndarray:
        n = len(self.sides)
        s = np.bincount(self.i1.view(), g, n) - np.bincount(self.i2.view(), g, n)
        if self.replace:
            s -= np.bincount(self.i3.view(), g, n)
        return np.bincount(self.scol.view(), self.sval.view() * s[self.srow.view()], len(self.players))

    def facts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Outcome, signed margin, and whether the margin counts."""
        m = self.s1.view() - self.s2.view()
        y = np.sign(m)
        return y, m, (y != 0) & ~self.only.view()

    def appearances(self) -> np.ndarray:
        """Games of each player; one on both sides counts twice."""
        n = len(self.sides)
        t = self.times.view()
        c = np.bincount(self.i1.view(), t, n) + np.bincount(self.i2.view(), t, n)
        return np.bincount(self.scol.view(), c[self.srow.view()], len(self.players))

    row = property(lambda self: self.coo()[0])
    col = property(lambda self: self.coo()[1])
    val = property(lambda self: self.coo()[2])

    def coo(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, col, val) of the whole matrix, for small tables."""
        x = np.array([self.dot(e) for e in np.eye(len(self.players))]).T.reshape(len(self), -1)
        row, col = np.nonzero(x)
        return row, col, x[row, col]


def design(games: list[Game], replace: bool = False) -> Ledger:
    out = Ledger(replace)
    for g in games:
        out.add(g)
    return out


#: Players up to whom Newton's equations are solved as they stand, and sides that they may have.
DENSE, SIDES = 400, 1500


class Pooled:
    """A ledger's games by pairs of sides: dot() and back() as the ledger's, with a row for each pair. ``inverse``: of the curvature at an earlier point, for the next steps from there."""

    def __init__(self, d: Ledger):
        self.d, self.inverse = d, None

    def dot(self, theta: np.ndarray) -> np.ndarray:
        d = self.d
        u = np.bincount(d.srow.view(), d.sval.view() * theta[d.scol.view()], len(d.sides))
        x = u[d.p1.view()] - u[d.p2.view()]
        return x - u[d.p3.view()] if d.replace else x

    def back(self, g: np.ndarray) -> np.ndarray:
        d = self.d
        n = len(d.sides)
        s = np.bincount(d.p1.view(), g, n) - np.bincount(d.p2.view(), g, n)
        if d.replace:
            s -= np.bincount(d.p3.view(), g, n)
        return np.bincount(d.scol.view(), d.sval.view() * s[d.srow.view()], len(d.players))

    def dense(self) -> bool:
        return len(self.d.players) <= DENSE and len(self.d.sides) <= SIDES

    def invert(self, h: np.ndarray, ridge: np.ndarray) -> bool:
        """The inverse for curvatures ``h`` of the pairs; False if there is none in floats."""
        d, n = self.d, len(self.d.sides)
        ends = [(d.p1.view(), 1), (d.p2.view(), -1), *([(d.p3.view(), -1)] if d.replace else [])]
        lap = sum(a * b * np.bincount(i * n + k, h, n * n) for i, a in ends for k, b in ends).reshape(n, n)
        own = np.zeros((n, len(d.players)))
        np.add.at(own, (d.srow.view(), d.scol.view()), d.sval.view())
        full = own.T @ lap @ own
        full[np.diag_indices(len(full))] += 2 * ridge
        try:
            self.inverse = np.linalg.inv(full)
        except np.linalg.LinAlgError:
            self.inverse = None
        if self.inverse is not None and not np.isfinite(self.inverse).all():
            self.inverse = None
        return self.inverse is not None


def minimise(d: Ledger | Pooled, data, ridge: np.ndarray, theta: np.ndarray, tol: float = 1e-8) -> np.ndarray:
    """Newton steps with backtracking. ``data(d)`` gives loss, slope and curvature of each game; ``ridge``: weights of theta squared.

    Of a pooled ledger with few players the equations are solved by an inverse, which serves again while it takes the gradient down to a tenth a step."""

    def at(t):
        loss, g, h = data(d.dot(t))
        return loss.sum() + (ridge * t**2).sum(), d.back(g) + 2 * ridge * t, h

    total, grad, h = at(theta)
    solve, before = isinstance(d, Pooled) and d.dense(), np.inf
    for _ in range(100):
        worst = np.abs(grad).max(initial=0)
        if worst < tol:
            break
        old = solve and d.inverse is not None and len(d.inverse) == len(theta) and worst <= 0.1 * before
        if solve and (old or d.invert(h, ridge)):
            step = -(d.inverse @ grad)
        else:
            solve, step = False, _conjugate(d, h, ridge, grad, tol)
        before, size = worst, 1.0
        while size > 1e-10:
            t = theta + size * step
            new = at(t)
            if new[0] <= total + 1e-4 * size * (grad @ step) + 1e-13 * abs(total):
                theta, (total, grad, h) = t, new
                break
            size /= 2
        else:
            if not old:
                break
            d.inverse = None
    return theta


def _conjugate(d, h: np.ndarray, ridge: np.ndarray, grad: np.ndarray, tol: float) -> np.ndarray:
    """A Newton step by conjugate gradients."""
    step, r = np.zeros_like(grad), -grad
    p, rr = r.copy(), r @ r
    for _ in range(4 * len(grad) + 20):
        hp = d.back(h * d.dot(p)) + 2 * ridge * p
        curve = p @ hp
        if curve <= 0 or rr < 1e-28:
            break
        a = rr / curve
        step += a * p
        r = r - a * hp
        new = r @ r
        if new < 1e-4 * tol * tol:
            break
        p, rr = r + new / rr * p, new
    return step


@dataclass
class BatchModel:
    """Collects games; converge() solves, from the last solution on; predict() uses the last fit."""

    REPLACE = False
    ledger: Ledger | None = None
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    dirty: bool = False
    pool: Pooled | None = None

    def __post_init__(self):
        self.ledger = Ledger(self.REPLACE, merge=True)

    @property
    def theta(self) -> dict:
        return dict(zip(self.ledger.players, self.values.tolist(), strict=False))

    def update(self, g: Game) -> None:
        self.ledger.add(g)
        self.dirty = True

    def converge(self) -> None:
        if self.dirty:
            self.values = np.concatenate([self.values, np.zeros(len(self.ledger.players) - len(self.values))])
            self.fit()
        self.dirty = False

    def converge_all(self) -> None:
        self.converge()

    def skill(self, side: list, counts: list, size: int) -> float:
        at, n = self.ledger.at, len(self.values)
        return sum(c * self.values[k] for k, c in ((at.get(p, n), c) for p, c in zip(side, counts, strict=True)) if k < n) / size if side else 0.0

    def gap(self, g: Game) -> float:
        self.converge()
        return float(self.skill(*g.side(1)) - self.skill(*g.side(2)))

    def _pooled(self) -> Pooled:
        if self.pool is None:
            self.pool = Pooled(self.ledger)
        return self.pool

    def _solve(self, data, ridge) -> None:
        """``data``: of the ledger's pairs."""
        self.values = minimise(self._pooled(), data, ridge * self.ledger.count.view(), self.values)

    def noise_of_all(self) -> float:
        """The noise that every game has."""
        return 1.0

    def terms(self, y, m, on, s, w):
        """Loss, slope and curvature of each game as functions of d: outcomes, margins, whether they count, noise and weights are given."""
        return _probit(y, m, on, s, w)

    def shown(self) -> np.ndarray:
        """Ratings of all known players."""
        return 1000.0 + getattr(self, "spread", 200.0) * self.values

    def table(self) -> tuple[list, list, list]:
        """Players, skills and ratings."""
        return list(self.ledger.players), self.values.tolist(), self.shown().tolist()

    def expose(self, p) -> float:
        self.converge()
        k = self.ledger.at.get(p)
        return 1000.0 if k is None else float(self.shown()[k])


def _facts(games: list[Game]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return design(games).facts()


@dataclass
class MarginBT(BatchModel):
    """Bradley-Terry outcome and Gaussian margin together; draws are constant."""

    lam: float = 0.0613
    sigma: float = 5.9032

    def noise_of_all(self) -> float:
        return max(self.sigma, 1e-4)

    def terms(self, y, m, on, s, w):
        s2 = s * s

        def at(x):
            p = 1 / (1 + np.exp(-y * x))
            loss = np.where(y != 0, np.logaddexp(0, -y * x), math.log(2)) + on * (0.5 * np.log(s2) + (x - m) ** 2 / (2 * s2))
            return loss, np.where(y != 0, -y * (1 - p), 0) + on * (x - m) / s2, np.where(y != 0, p * (1 - p), 0) + on / s2

        return at

    def fit(self) -> None:
        win, lose, m1, m2, win_only, lose_only, drawn = self.ledger.tallies()
        on, win, lose, s2 = win + lose, win + win_only, lose + lose_only, self.noise_of_all() ** 2
        constant = on * 0.5 * math.log(s2) + m2 / (2 * s2) + drawn * math.log(2)

        def at(x):
            e = np.exp(-np.abs(x))
            p = np.where(x >= 0, 1.0, e) / (1 + e)
            loss = (win + lose) * np.log1p(e) + win * np.maximum(-x, 0) + lose * np.maximum(x, 0) + (on * x * x - 2 * x * m1) / (2 * s2) + constant
            return loss, lose * p - win * (1 - p) + (on * x - m1) / s2, (win + lose) * p * (1 - p) + on / s2

        self._solve(at, self.lam)

    def predict(self, g: Game) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.gap(g)))))


@dataclass
class DecayBT(BatchModel):
    """Davidson outcomes weighted by margin and age. Without a draw share (nu = 0) draws carry no information."""

    lam: float = 0.06
    nu: float = 0.0
    decay: float = 0.98

    def __post_init__(self):
        # without a positive decay every game keeps a row and its own age
        self.ledger = Ledger(merge=self.decay > 0, decay=self.decay if self.decay > 0 else None)

    def fit(self) -> None:
        x = self.ledger
        y, m, on = x.facts()
        if x.merge:
            w = x.aged()
        else:
            day = x.day.view()
            ref = np.nanmax(day) if np.isfinite(day).any() else 0.0
            w = x.times.view() * self.decay ** np.where(np.isnan(day), 0.0, np.maximum(0.0, ref - day) / 7)
        w = (1 + np.log1p(np.abs(m))) * w
        win, lose, drawn = (np.bincount(x.pair.view(), np.where(k, w, 0.0), x.p1.n) for k in (y > 0, y < 0, y == 0))
        if self.nu <= 0:
            drawn = np.zeros_like(drawn)
        log_nu = math.log(self.nu) if self.nu > 0 else -np.inf
        of_draws = drawn * log_nu if self.nu > 0 else drawn
        total = win + lose + drawn

        def at(d):
            log_z = np.logaddexp(np.logaddexp(0, d), log_nu)
            p = np.exp(d - log_z)
            return total * log_z - win * d - of_draws, total * p - win, total * p * (1 - p)

        self._solve(at, self.lam)

    def terms(self, y, m, on, s, w):
        if self.nu <= 0:
            w = np.where(y == 0, 0.0, w)
        log_nu = math.log(self.nu) if self.nu > 0 else -np.inf

        def at(x):
            log_z = np.logaddexp(np.logaddexp(0, x), log_nu)
            p = np.exp(x - log_z)
            ll = np.where(y > 0, x, np.where(y < 0, 0.0, log_nu if self.nu > 0 else 0.0)) - log_z
            return -w * ll, w * (p - (y > 0)), w * p * (1 - p)

        return at

    def predict(self, g: Game) -> float:
        x = max(-700.0, min(700.0, self.gap(g)))
        return math.exp(x) / (1 + math.exp(x) + self.nu)


def _probit(y, m, on, s, w):
    """Loss, slope and curvature: margins by density, others by distribution function."""

    def at(x):
        lp, ratio = log_cdf(y * x / s)
        out = (~on) & (y != 0)
        loss = np.where(on, 0.5 * np.log(s * s) + (x - m) ** 2 / (2 * s * s), np.where(out, -lp, math.log(2)))
        g = np.where(on, (x - m) / (s * s), np.where(out, -y * ratio / s, 0.0))
        h = np.where(on, 1 / (s * s), np.where(out, ratio * (ratio + y * x / s) / (s * s), 0.0))
        return w * loss, w * g, w * h

    return at


def _probit_of_pairs(tallies: np.ndarray, s):
    """_probit() of all games of each pair of sides; ``s``: the noise of one, or of each pair."""
    win, lose, m1, m2, win_only, lose_only, drawn = tallies
    on, v = win + lose, np.square(s)
    constant = on * 0.5 * np.log(v) + m2 / (2 * v) + drawn * math.log(2)

    def at(x):
        z = x / s
        (lw, rw), (ll, rl) = log_cdf(z), log_cdf(-z)
        loss = (on * x * x - 2 * x * m1) / (2 * v) - win_only * lw - lose_only * ll + constant
        return loss, (on * x - m1) / v - (win_only * rw - lose_only * rl) / s, (on + win_only * rw * (rw + z) + lose_only * rl * (rl - z)) / v

    return at


@dataclass
class VetBT(BatchModel):
    """Probit or margin, with a ridge that a player's games wear down."""

    sigma0: float = 0.2246
    beta: float = 9.1085
    sigma: float = 4.5916
    spread: float = 100.0

    def fit(self) -> None:
        self._solve(_probit_of_pairs(self.ledger.tallies(), self.noise_of_all()), self.ridge(self.ledger.appearances()))

    def noise_of_all(self) -> float:
        return max(self.sigma, 1e-4)

    def ridge(self, appearances: np.ndarray) -> np.ndarray:
        return self.sigma0 / (1 + self.beta * appearances)

    def predict(self, g: Game) -> float:
        return phi(self.gap(g) / max(self.sigma, 1e-8))


@dataclass
class UncertainBT(BatchModel):
    """Probit or margin whose noise grows with what is unknown of the players (team diversity)."""

    sigma: float = 4.2458
    lam: float = 3.15e-05
    best: float = 2000.0
    REPLACE = True
    sigmas: dict = field(default_factory=dict)
    rosters: dict = field(default_factory=dict)  # team -> players, in order of first appearance
    teams: dict = field(default_factory=dict)  # player -> teams, in order
    changed: bool = True
    standing: Standing | None = None

    def update(self, g: Game, teams: tuple | None = None) -> None:
        super().update(g)
        for t, side in zip(teams or g.teams or (("1", *g.r1), ("2", *g.r2)), (g.r1, g.r2), strict=True):
            own = self.rosters.setdefault(t, set())
            if not own.issuperset(side):
                own.update(side)
                self.changed = True
            for p in side:
                mine = self.teams.setdefault(p, [])
                if t not in mine:
                    mine.append(t)
                    self.changed = True

    def complexity(self, p) -> float:
        total, done = 0.0, []
        for t in self.teams.get(p, []):
            a = self.rosters[t]
            total += 1 - max((self._size(a & self.rosters[u]) / self._size(a | self.rosters[u]) for u in done), default=0.0)
            done.append(t)
        return total

    def _size(self, players: set) -> float:
        return sum(self.ledger.count.data[self.ledger.at[p]] for p in players)

    def _side(self, side: list, counts: list, size: int) -> float:
        return sum(n * self.sigmas.get(p, 1.0) ** 2 for p, n in zip(side, counts, strict=True)) / size**2 if side else 0.0

    def noise(self, g: Game) -> float:
        return math.sqrt(max(self.sigma**2 + self._side(*g.side(1)) + self._side(*g.side(2)), 1e-8))

    def _variances(self) -> np.ndarray:
        """Squared sigmas of the ledger's players."""
        return np.array([self.sigmas.get(p, 1.0) for p in self.ledger.players]) ** 2

    def fit(self) -> None:
        if self.changed:
            self.sigmas = {p: max(1 / math.sqrt(1 + self.complexity(p)), 1e-8) for p in self.teams}
            self.changed = False
        x = self.ledger
        side = np.bincount(x.srow.view(), x.sval.view() ** 2 * (self._variances() / x.count.view())[x.scol.view()], len(x.sides))
        noise = np.sqrt(np.maximum(self.sigma**2 + side[x.p1.view()] + side[x.p2.view()], 1e-8))
        self._solve(_probit_of_pairs(x.tallies(2.0), noise), self.lam)

    def shown(self) -> np.ndarray:
        """The mean probability to beat each other active player (each has a game here), times ``best``."""
        n = self.ledger.count.view()[: len(self.values)]
        if n.sum() < 2:
            return np.full(len(n), self.best)
        if self.standing is None or self.standing.sigma != self.sigma:
            self.standing = Standing(self.sigma)
        out = self.standing.sums(self.values, self._variances(), n)
        return (out - 0.5) / (n.sum() - 1) * self.best

    def predict(self, g: Game) -> float:
        return phi(self.gap(g) / self.noise(g))


@dataclass
class NormalBT(BatchModel):
    """Probit or margin with a learned prior scale: tau^2 = (sum theta^2 + 2 b) / (n + a) at the optimum."""

    sigma: float = 1.1688
    a: float = 5.0
    b: float = 20.0
    tau: float = 1.0

    def noise_of_all(self) -> float:
        return max(self.sigma, 1e-8)

    def fit(self) -> None:
        x, theta = self.ledger, self.values
        data = _probit_of_pairs(x.tallies(2.0), self.noise_of_all())
        n = x.count.view()
        tau2 = self.tau**2
        for _ in range(200):
            theta = minimise(self._pooled(), data, n / (2 * tau2), theta)
            new = ((n * theta**2).sum() + 2 * self.b) / (x.size + self.a)
            if abs(new - tau2) < 1e-10 * tau2:
                break
            tau2 = new
        self.values, self.tau = theta, math.sqrt(tau2)

    def shown(self) -> np.ndarray:
        return 1000.0 + 200.0 * self.values / self.tau

    def predict(self, g: Game) -> float:
        return phi(self.gap(g) / max(self.sigma, 1e-8))

    def expose(self, p) -> float:
        self.converge()
        return self.tau if p == "Tau" else super().expose(p)
