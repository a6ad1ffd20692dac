"""All rating models by name."""

from __future__ import annotations

from laddersmith.operators import map_models as B
from laddersmith.operators import sequential as S

SEQUENTIAL = {"elo": S.Elo, "trueskill": S.TrueSkill, "trueskill_mov": S.TrueSkillMargin, "ttt": S.ThroughTime}
BATCH = {"bt_mov": B.MarginBT, "bt_mov_time_decay": B.DecayBT, "bt_vet": B.VetBT, "bt_uncert": B.UncertainBT, "bt_normal": B.NormalBT}
MODELS = SEQUENTIAL | BATCH
#: Models with a scale or a reference time that all leagues share.
SHARED = {"bt_normal", "bt_mov_time_decay"}
#: Models for which equal games of different times are not the same.
DATED = {"bt_mov_time_decay"}

#: Names that configurations use for parameters, where ours differ.
ALIASES = {
    "elo": {"initial_elo": "initial", "K": "k", "tournament_multiplier": "tournament_factor"},
    "trueskill": {"draw_probability": "draw"}, "trueskill_mov": {"draw_probability": "draw"},
    "ttt": {"convergence_iterations": "iterations"},
    "bt_mov": {"lambda_reg": "lam"}, "bt_mov_time_decay": {"lambda_reg": "lam", "decay_base": "decay"},
    "bt_vet": {"sigma_0": "sigma0"}, "bt_uncert": {"l2_lambda": "lam"},
    "bt_normal": {"tau_gamma_a": "a", "tau_gamma_b": "b"},
}
#: Parameters that configurations may name but that change nothing.
IGNORED = {"alpha", "display_center", "display_spread", "max_rating", "default_rating_mean", "default_rating_spread", "warm_start"}


def make(name: str, params: dict | None = None):
    """A new model; unknown parameters raise."""
    names = ALIASES.get(name, {})
    own = {names.get(k, k): v for k, v in (params or {}).items() if k not in IGNORED}
    if "iterations" in own:
        own["iterations"] = int(own["iterations"])
    return MODELS[name](**own)


def decay(name: str, params: dict | None = None) -> float | None:
    """By what a model's games fade each week, if that is all that their times are to it."""
    d = getattr(make(name, params), "decay", None) if name in DATED else None
    return d if d is not None and d > 0 else None
