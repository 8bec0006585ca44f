"""Minutes per patient-day: admission, discharge and newborn rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pflegetakt.functions.missing import if_known, key_text
from pflegetakt.operators.rows import expand_days, forward_spans
from pflegetakt.operators.skew import HotCases, scan_keys
from pflegetakt.plans.patient_days import base_value
from pflegetakt.settings import Settings


def admission(day: Column, control: Mapping[str, Column]) -> Column:
    """Admission minutes on the first day of a case."""
    return if_known(day == F.col("first_day"), control["admission"], F.lit(0.0))


def fixed_minutes(day: Column, isolated: Column, control: Mapping[str, Column]) -> Column:
    """Minutes of a day that do not depend on the category."""
    return base_value(isolated, control) + admission(day, control)


def _discharge(minutes_before: Column, control: Mapping[str, Column]) -> Column:
    """A share of the previous row's minutes on the last day of a case."""
    share = minutes_before * control["discharge"]
    return if_known(F.col("tag") == F.col("last_day"), share, F.lit(0.0))


def at_midnight() -> Column:
    """A patient is there at midnight on all days but the last."""
    return (F.col("tag") != F.col("last_day")).cast("int")


def weigh_days(days: DataFrame, control: Mapping[str, Column]) -> DataFrame:
    """Total minutes: on the last day a share of the previous row's total.

    A case of one row has no previous total, so its total is missing.
    """
    before = F.col("before")
    total_before = before["wert"] + fixed_minutes(before["tag"], before["iso"], control)
    return (
        days.withColumns(
            {
                "aufnahmewert": admission(F.col("tag"), control),
                "tageswert": F.col("wert") + fixed_minutes(F.col("tag"), F.col("iso"), control),
                "nachts_da": at_midnight(),
                "entlasswert": _discharge(total_before, control),
            }
        )
        .withColumn("gesamtwert", if_known(F.col("entlasswert") > 0, F.col("entlasswert"), F.col("tageswert")))
        .drop("before", "control")
    )


def weigh_days_older(days: DataFrame, control: Mapping[str, Column]) -> DataFrame:
    """Older total: base and admission minutes always count, and the discharge
    share is taken of the previous row's category minutes alone."""
    discharge = _discharge(F.col("before")["wert"], control)
    return days.withColumns(
        {
            "aufnahmewert": admission(F.col("tag"), control),
            "nachts_da": at_midnight(),
            "entlasswert": discharge,
            "gesamtwert": fixed_minutes(F.col("tag"), F.col("iso"), control)
            + if_known(discharge > 0, discharge, F.col("wert")),
        }
    ).drop("before", "control")


def _newborn_days_of(newborns: DataFrame) -> DataFrame:
    return newborns.withColumns(
        {
            "begin_day": F.col("birth").cast("date"),
            "end_day": F.col("discharge").cast("date"),
        }
    )


def newborn_spans(newborns: DataFrame) -> DataFrame:
    """Distinct newborn stays; open and reversed ones are dropped, see ``rejected_newborns``."""
    spans = _newborn_days_of(newborns).select(
        key_text(F.col("case_id")).alias("case_key"), "begin_day", "end_day"
    )
    return forward_spans(spans, "begin_day", "end_day").distinct()


def rejected_newborns(newborns: DataFrame) -> DataFrame:
    """Reject table: records without birth or discharge, or with a discharge before birth."""
    counts = F.coalesce(F.col("begin_day") <= F.col("end_day"), F.lit(False))
    return _newborn_days_of(newborns).filter(~counts).drop("begin_day", "end_day")


def newborn_checks(newborns: DataFrame) -> DataFrame:
    """How many newborn records count, lack birth or discharge, or end before they begin.

    A record that lacks both is counted among those without birth.
    """
    begin, end = F.col("begin_day"), F.col("end_day")
    return _newborn_days_of(newborns).agg(
        F.count_if(begin <= end).alias("counted"),
        F.count_if(begin.isNull()).alias("without_birth"),
        F.count_if(begin.isNotNull() & end.isNull()).alias("without_discharge"),
        F.count_if(begin > end).alias("reversed"),
    )


def newborn_days(spans: DataFrame, settings: Settings) -> DataFrame:
    """Newborn stays to days with a flat rate.

    Distinct stays give distinct days, and the last day of a case is its latest
    end, so both are settled before the rows multiply.
    """
    bounds = spans.withColumns(
        {
            "auftag": F.col("begin_day"),
            "enttag": F.col("end_day"),
            "last_day": F.max("end_day").over(Window.partitionBy("case_key")),
        }
    )
    return expand_days(bounds, "begin_day", "end_day").select(
        "case_key",
        "auftag",
        "enttag",
        "tag",
        F.lit(settings.newborn_ward).alias("ward"),
        F.lit(settings.newborn_minutes).alias("gesamtwert"),
        F.lit(0).alias("imputed"),
        at_midnight().alias("nachts_da"),
        F.lit(settings.newborn_code).alias("code"),
    )


def mark_newborns(days: DataFrame, spans: DataFrame, hot: HotCases) -> DataFrame:
    """Adds ``is_newborn`` to the days of newborn cases.

    The join meets the days on the shuffle of their windows. It is written as an outer join, because
    Catalyst would push an anti-join below the case windows, and the ward means, which are taken
    before newborns leave, could then no longer share that shuffle.
    """
    cases = scan_keys(spans.select("case_key").distinct(), hot)
    marks = cases.select("scan_key", F.lit(True).alias("is_newborn"))
    return days.join(marks, "scan_key", "left")


def without_cases(days: DataFrame, spans: DataFrame, hot: HotCases) -> DataFrame:
    """Days of cases that are not among the newborns."""
    return mark_newborns(days, spans, hot).filter(F.col("is_newborn").isNull()).drop("is_newborn")


def replace_newborns(
    days: DataFrame, spans: DataFrame, hot: HotCases, settings: Settings
) -> DataFrame:
    """Drops newborn cases and adds their flat-rate days."""
    return without_cases(days, spans, hot).unionByName(
        newborn_days(spans, settings), allowMissingColumns=True
    )
