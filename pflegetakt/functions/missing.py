"""Missing-value rules that differ from SQL defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def if_known(test: Column, then, otherwise) -> Column:
    """Two-way choice that is missing when the test is missing."""
    return F.when(test, then).when(~test, otherwise)


def strict_sum(value: Column) -> Column:
    """Sum that is missing as soon as one input is missing."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def strict_mean(value: Column) -> Column:
    """Mean that is missing as soon as one input is missing."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.avg(value))


def sum_or_zero(value: Column) -> Column:
    """Sum over the known inputs; 0 when none is known."""
    return F.coalesce(F.sum(value), F.lit(0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is missing for a zero denominator."""
    return F.try_divide(numerator, denominator)


def key_text(key: Column) -> Column:
    """Never-null text of a key; a missing key gets a value of its own.

    Missing keys match each other in joins. ``<=>`` says the same, but Spark
    turns it into two derived join keys, so a table already shuffled by the key
    would be shuffled again. Equality on this text reuses the earlier shuffle.
    """
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def key_value(text: Column) -> Column:
    """The key that ``key_text`` encoded."""
    return F.when(text != "", F.substring(text, 2, 2_147_483_647))
