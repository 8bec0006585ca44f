"""Day, moment and time-of-day texts with two accepted layouts each.

The layout is chosen by its shape first. A parse attempt that fails costs an
exception per row, so no row is tried with a pattern it cannot match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = r"\d{1,2}\.\d{1,2}\."
_CLOCK = r"([01]?\d|2[0-3]):[0-5]?\d"


def _pivot(day: Column) -> Column:
    """Two-digit years 69 to 99 belong to the twentieth century."""
    return F.when(F.year(day) > 2068, F.add_months(day, -1200)).otherwise(day)


def parse_day(text: Column) -> Column:
    """``d.m.yyyy`` or ``d.m.yy`` to a date; anything else is missing.

    A day has at most eight texts: each part has two spellings.
    """
    long_year = F.try_to_date(text, "d.M.yyyy")
    short_year = F.try_to_date(text, "d.M.yy")
    return F.when(text.rlike(f"^{_DAY}\\d{{4}}$"), long_year).when(
        text.rlike(f"^{_DAY}\\d{{2}}$"), _pivot(short_year)
    )


def parse_moment_day(text: Column) -> Column:
    """``d.m.yyyy H:M`` or ``d.m.yy H:M`` to its date; anything else is missing.

    The clock must be there and be valid, but only the date is kept.
    """
    shaped = text.rlike(f"^{_DAY}(\\d{{2}}|\\d{{4}}) +{_CLOCK}$")
    return F.when(shaped, parse_day(F.split_part(text, F.lit(" "), F.lit(1))))


def parse_clock(text: Column) -> Column:
    """``H:M:S`` or ``H:M`` to ``HH:mm:ss`` text; anything else is missing."""
    full = F.when(text.rlike(r"^\d{1,2}:\d{1,2}:\d{1,2}$"), text).when(
        text.rlike(r"^\d{1,2}:\d{1,2}$"), F.concat(text, F.lit(":0"))
    )
    return F.date_format(F.try_to_timestamp(full, F.lit("H:m:s")), "HH:mm:ss")
