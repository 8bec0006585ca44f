"""Report tables over ward-days: at most wards times days rows go in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pflegetakt.functions.missing import if_known, ratio, strict_mean, strict_sum
from pflegetakt.plans.ward_days import with_master
from pflegetakt.settings import Settings


def _months(settings: Settings) -> list[Column]:
    month = F.month("Tag").alias("Monat")
    return [F.year("Tag").alias("Jahr"), month] if settings.by_year else [month]


def _month_names(settings: Settings) -> list[str]:
    return ["Jahr", "Monat"] if settings.by_year else ["Monat"]


def monthly_shifts(ward_days: DataFrame, settings: Settings) -> DataFrame:
    """Day and night rows per ward and month.

    Both shifts are aggregated in one pass and then unfolded, which equals the
    union of a day and a night aggregate without reading ward-days twice. Distinct
    days are bits of a calendar month, so they need no shuffle of their own; months
    of different years meet in the second, small aggregate.
    """
    values = {
        "day_patients": F.col("Patiententage"),
        "day_vk": F.col("VK_tag"),
        "night_patients": F.col("Patienten_mitternacht"),
        "night_vk": F.col("VK_nacht"),
    }
    day = F.call_function("shiftleft", F.lit(1), F.dayofmonth("Tag") - 1)
    calendar = ward_days.groupBy("Station2", F.year("Tag").alias("Jahr"), F.month("Tag").alias("Monat")).agg(
        F.bit_or(day).alias("days"),
        F.count(F.lit(1)).alias("n"),
        *[F.sum(value).alias(name) for name, value in values.items()],
        *[F.count(value).alias(f"{name}_n") for name, value in values.items()],
    )

    def total(name: str) -> Column:
        """Missing as soon as one ward-day lacks the value."""
        return F.when(F.sum(f"{name}_n") == F.sum("n"), F.sum(name))

    def mean(name: str) -> Column:
        return F.try_divide(F.sum(name), F.sum(f"{name}_n"))

    both = calendar.groupBy("Station2", *_month_names(settings)).agg(
        F.sum(F.bit_count("days")).alias("Anzahl_Schichten"),
        *[total(name).alias(name) for name in values],
        *[mean(f"{shift}_patients").alias(f"{shift}_mean") for shift in ("day", "night")],
    )

    def shift(rank: int, label: str, prefix: str) -> Column:
        return F.struct(
            F.lit(rank).alias("shift_rank"),
            F.lit(label).alias("Schicht"),
            F.col(f"{prefix}_patients").alias("Anzahl_Patienten"),
            F.col(f"{prefix}_mean").alias("durchschnittliche_Patientenbelegung"),
            ratio(F.col(f"{prefix}_vk"), F.col("Anzahl_Schichten")).alias("VK"),
        )

    shifts = F.array(shift(0, settings.day_label, "day"), shift(1, settings.night_label, "night"))
    keys = ["Station2", *_month_names(settings), "Anzahl_Schichten"]
    return both.select(*keys, F.explode(shifts).alias("s")).select(*keys, "s.*")


def monthly_report(shifts: DataFrame, master: DataFrame, settings: Settings) -> DataFrame:
    """Staffing per ward, month and shift, with master data and fixed labels."""
    rows = with_master(
        shifts, master, ["kategorie", "betten", "ausfall1", "ausfall2", "ausfall3"]
    )
    months = _month_names(settings)
    return (
        rows.select(
            F.lit(settings.site).alias("Standortkennzeichen"),
            "Station2",
            F.lit(settings.department_key).alias("FAB_Key"),
            F.lit(settings.department_name).alias("FAB_Name"),
            F.col("kategorie").alias("Kategorie"),
            *months,
            "Schicht",
            "Anzahl_Schichten",
            F.col("betten").alias("Anzahl_Betten"),
            "Anzahl_Patienten",
            "durchschnittliche_Patientenbelegung",
            if_known(F.col("Station2") == settings.newborn_ward, F.lit("ja"), F.lit("nein")).alias(
                "Station_GynGeb"
            ),
            F.col("VK").alias("Soll_Besetzung"),
            F.col("ausfall1").alias("Ausfall1"),
            F.col("ausfall2").alias("Ausfall2"),
            F.col("ausfall3").alias("Ausfall3"),
            (F.col("VK") / settings.lead_ratio).alias("Leitende_Pflege"),
        )
    )


def in_report_order(report: DataFrame, settings: Settings) -> DataFrame:
    """By ward, month and shift, the day first; for the sink, as other steps need no order."""
    night = (F.col("Schicht") != settings.day_label).cast("int")
    return report.orderBy("Station2", *_month_names(settings), night)


def ward_month_total(report: DataFrame, settings: Settings) -> DataFrame:
    """Posts of both shifts and their lead, and the mean census, per ward and month."""
    return report.groupBy("Station2", *_month_names(settings)).agg(
        (strict_sum(F.col("Soll_Besetzung")) + strict_sum(F.col("Leitende_Pflege"))).alias("VK_ges"),
        strict_mean(F.col("durchschnittliche_Patientenbelegung")).alias("mittlere_Belegung"),
    )


def missing_report(ward_days: DataFrame, settings: Settings) -> DataFrame:
    """Patient-days, imputed ones and their share per ward and month."""
    return (
        ward_days.groupBy("Station2", *_months(settings))
        .agg(
            strict_sum(F.col("Patiententage")).alias("Tage"),
            strict_sum(F.col("Fehlende_Tageswerte")).alias("Fehlend"),
        )
        .withColumn("Anteil_fehlend", ratio(F.col("Fehlend"), F.col("Tage")))
    )


def vk_by_qualification(ward_days: DataFrame, absence: Column, settings: Settings) -> DataFrame:
    """Posts of examined nurses and helpers per ward, year and month."""
    minutes = F.lit(settings.minutes_per_month) * (1 - absence)
    return (
        ward_days.groupBy("Station2", F.year("Tag").alias("Jahr"), F.month("Tag").alias("Monat"))
        .agg(
            F.coalesce(F.sum("Minuten_exam_gesamt"), F.lit(0.0)).alias("Examiniert"),
            F.coalesce(F.sum("Minuten_hilf_gesamt"), F.lit(0.0)).alias("Hilf"),
            strict_sum(F.col("Fehlende_Tageswerte")).alias("Fehlende_Tageswerte"),
            strict_sum(F.col("Patiententage")).alias("Patiententage"),
        )
        .withColumns(
            {
                "VK_Exam": ratio(F.col("Examiniert"), minutes),
                "VK_Hilf": ratio(F.col("Hilf"), minutes),
                "Anteil_fehlende_Werte": ratio(F.col("Fehlende_Tageswerte"), F.col("Patiententage")),
            }
        )
    )
