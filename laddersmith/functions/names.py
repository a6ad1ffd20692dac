"""Name normalisation and matching."""

from __future__ import annotations

import difflib
import os
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType


# Cells that stand for no player, and parts of such cells.
PLACEHOLDERS, PLACEHOLDER_PARTS = ("add", "parent reserve player captain coach"), ("create new user", "search player")
# What page texts hold besides a name.
PIPE_ON, SCORE, VERSUS = r"\s+\|.*$", r"\d+[-–—]\d+", r"(?i)\b(vs?|@)\b\.?"
TITLE_CUT, BRACKET_ON, SITE_ON = r"\s(?:[|\uFF5C\-–—])\s", r"\s*\(", r"\s\|\sLeague and Tournament Scheduler"


def clean_team_name(c: Column) -> Column:
    """Cut from a spaced pipe on, white space collapsed, scores like 3-2 and the words v, vs and @ left out."""
    c = F.trim(F.regexp_replace(F.regexp_replace(c, PIPE_ON, ""), r"\s+", " "))
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, SCORE, "")), VERSUS, ""))


def team_name(s: str) -> str:
    """clean_team_name() of one text."""
    s = re.sub(r"\s+", " ", re.sub(PIPE_ON, "", s)).strip()
    return re.sub(VERSUS, "", re.sub(SCORE, "", s).strip()).strip()


def clean_header(c: Column) -> Column:
    """A team's name from a file's: no extension, nothing after a spaced pipe or dash, or from '(' on."""
    c = F.regexp_replace(c, r"^(\.*[^.].*)\.[^.]*$", "$1")
    return F.trim(F.split(F.split(c, TITLE_CUT, 2)[0], BRACKET_ON, 2)[0])


def header_of_file(filename: str) -> str:
    """clean_header() of one name."""
    return re.split(BRACKET_ON, re.split(TITLE_CUT, os.path.splitext(filename)[0], maxsplit=1)[0], maxsplit=1)[0].strip()


def placeholder(s: str) -> bool:
    """is_placeholder() of one text."""
    k = " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())
    return k in ("", *PLACEHOLDERS) or any(p in k for p in PLACEHOLDER_PARTS)


def lookup_key(c: Column) -> Column:
    """Lower case; letters and digits stay, all else becomes one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def simple_key(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


@pandas_udf(StringType())
def alias_key(names: pd.Series) -> pd.Series:
    """NFKD without marks, lower case, quotes, dots, dashes and brackets deleted, other signs to one space."""
    drop = str.maketrans("", "", "'\".`-()")

    def one(s):
        if s is None:
            return ""
        t = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower().translate(drop)
        return " ".join("".join(c if c.isascii() and (c.isalnum() or c.isspace()) else " " for c in t).split())

    return names.map(one, na_action=None)


def last_name(c: Column) -> Column:
    return F.element_at(F.split(F.trim(F.lower(c)), r"\s+"), -1)


@pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; the order of the arguments matters."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def is_placeholder(c: Column) -> Column:
    """Cells that stand for no player."""
    k = lookup_key(F.coalesce(c, F.lit("")))
    return (k == "") | k.isin(*PLACEHOLDERS) | k.contains(PLACEHOLDER_PARTS[0]) | k.contains(PLACEHOLDER_PARTS[1])


def with_season(name: Column, suffix: Column) -> Column:
    return F.concat_ws(" ", name, suffix)
