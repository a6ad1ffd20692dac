"""Time parsing and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCKS = (" H:m:s", " H:m", "")


def parse_time(c: Column) -> Column:
    """The first that fits of M/D/YYYY and M/D/YY, each with seconds, minutes or no clock; else null.

    Two-digit years from 69 on are of the 1900s.
    """
    c = F.trim(c)
    four = [F.try_to_timestamp(c, F.lit("M/d/yyyy" + k)) for k in _CLOCKS]
    two = [F.try_to_timestamp(c, F.lit("M/d/yy" + k)) for k in _CLOCKS]
    short = F.coalesce(*two)
    short = F.when(F.year(short) >= 2069, short - F.expr("INTERVAL 100 YEARS")).otherwise(short)
    return F.coalesce(*four, short)


def format_time(ts: Column) -> Column:
    """M/D/YYYY H:MM:00."""
    return F.date_format(ts, "M/d/yyyy H:mm:'00'")


def parse_any_time(c: Column) -> Column:
    """ISO times as well as those of parse_time."""
    return F.coalesce(parse_time(c), F.try_to_timestamp(F.trim(c)))


def days(ts: Column) -> Column:
    return F.unix_timestamp(ts) / F.lit(86400.0)


def weeks_ago(ts: Column, ref: Column) -> Column:
    """Weeks from ``ts`` back from ``ref``: 0 when later or unknown."""
    return F.coalesce(F.greatest(F.unix_timestamp(ref) - F.unix_timestamp(ts), F.lit(0)) / F.lit(604800.0), F.lit(0.0))


def time_label(label: Column, day: Column) -> Column:
    """The original label, else the day with six decimals."""
    return F.coalesce(label, F.format_string("%.6f", day))
