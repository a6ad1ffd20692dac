"""Score policies: each consumer reads the same text in its own way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_int(c: Column) -> Column:
    """An integer with optional sign and white space around it, else null."""
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("int"))


def model_score(c: Column) -> Column:
    """Batch models, TTT and TrueSkill with margins: 0 or more, 0 if unreadable."""
    return F.greatest(F.coalesce(strict_int(c), F.lit(0)), F.lit(0))


def pair_or_zero(a: Column, b: Column) -> tuple[Column, Column]:
    """TrueSkill: both 0 if either is unreadable; negative scores stay."""
    x, y = strict_int(a), strict_int(b)
    ok = x.isNotNull() & y.isNotNull()
    return F.when(ok, x).otherwise(0), F.when(ok, y).otherwise(0)


def elo_scores(a: Column, b: Column, outcome_only: Column) -> tuple[Column, Column]:
    """Elo: unreadable scores are 0-0, or 1-0 in outcome-only games."""
    x, y = strict_int(a), strict_int(b)
    ok = x.isNotNull() & y.isNotNull()
    return F.when(ok, x).when(outcome_only, 1).otherwise(0), F.when(ok, y).otherwise(0)


def float_score(c: Column) -> Column:
    """Diagnostics: any number but NaN."""
    x = F.trim(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def flag(c: Column) -> Column:
    """Models: any text that isn't blank."""
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def export_flag(c: Column) -> Column:
    """Exports: exactly 1."""
    return F.trim(F.coalesce(c, F.lit(""))) == "1"


def outcome(s1: Column, s2: Column) -> Column:
    return F.signum(s1 - s2).cast("int")


def is_margin(s1: Column, s2: Column, outcome_only: Column) -> Column:
    return (s1 != s2) & ~outcome_only
