"""Number texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _plain_number(text: Column) -> Column:
    """Casts digits with a decimal point; type suffixes, words for no number and numbers too large
    for a double are missing."""
    number = F.when(text.rlike(_NUMBER), text).try_cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def parse_decimal_comma(text: Column) -> Column:
    """``1.234,5`` to 1234.5; anything that is no number is missing.

    Dots are dropped where they group thousands, three digits each. Any other dot is a
    decimal point, so ``1.5`` is one and a half.
    """
    text = F.trim(text)
    grouped = text.rlike(r"^[+-]?\d{1,3}(\.\d{3})+(,\d*)?$")
    digits = F.when(grouped, F.replace(text, F.lit("."), F.lit(""))).otherwise(text)
    return _plain_number(F.replace(digits, F.lit(","), F.lit(".")))


def to_number(value: Column) -> Column:
    """Number of a text with a decimal point; bad text is missing."""
    return _plain_number(F.trim(value.cast("string")))


def all_to_number(df: DataFrame, parse=to_number) -> DataFrame:
    """Every column as a number."""
    return df.select(*[parse(F.col(f"`{name}`")).alias(name) for name in df.columns])
