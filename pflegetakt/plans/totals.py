"""Ward-day totals with the ward means entering after the aggregation.

A day without minutes counts with the mean of its ward, and the mean needs all days of the ward. Put
into the rows, it takes a second pass over all patient-days. Here rows are summed first, apart by
what the mean can still change: known minutes, counts of missing ones, and discharge days whose
previous row has none. Means come from the same sums, which are few: wards times days.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pflegetakt.functions.missing import sum_or_zero
from pflegetakt.operators.lookups import merged_ward
from pflegetakt.plans.workload import at_midnight, fixed_minutes
from pflegetakt.settings import Settings


def ward_sums(
    rated: DataFrame, control: Mapping[str, Column], flag: str, older: bool = False
) -> DataFrame:
    """Sums per ward, day and kind of row.

    ``kind`` says what a row counts: ``day`` its day total, ``share`` the known share of the previous row,
    ``later`` one of both, which the mean of the previous row's ward decides, ``none`` nothing, as the
    first row of its case on the last day does. Older rules take the share of the category minutes
    alone and add the fixed minutes of the day.
    """
    before = F.col("before")
    own = fixed_minutes(F.col("tag"), F.col("iso"), control)
    fixed_before = F.lit(0.0) if older else fixed_minutes(before["tag"], before["iso"], control)
    share = (fixed_before + before["wert"]) * control["discharge"]
    kind = (
        F.when(F.col("tag") != F.col("last_day"), "day")
        .when(before.isNull(), "none")
        .when(before["wert"].isNull(), "later")
        .when(share > 0, "share")
        .when(share <= 0, "day")
        .otherwise("none")
    )
    rows = rated.select(
        "ward",
        "tag",
        "wert",
        kind.alias("kind"),
        own.alias("own"),
        share.alias("share"),
        control["discharge"].alias("discharge"),
        at_midnight().alias("nachts_da"),
        F.col(flag).alias("imputed"),
        F.col("wert").isNull().alias("is_missing"),
        (F.col("is_newborn") if "is_newborn" in rated.columns else F.lit(None)).isNotNull().alias("is_newborn"),
        F.when(kind == "later", before["ward"]).alias("ward_before"),
        F.when(kind == "later", fixed_before).alias("fixed_before"),
    )
    keys = ["ward", "tag", "kind", "is_missing", "is_newborn", "ward_before", "fixed_before"]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("own").alias("n_own"),
        F.sum("own").alias("own"),
        F.sum(F.col("own") + F.coalesce("wert", F.lit(0.0))).alias("known"),
        F.sum("share").alias("share"),
        F.max("discharge").alias("discharge"),
        F.sum("wert").alias("wert"),
        F.count("wert").alias("n_wert"),
        F.sum("nachts_da").alias("nights"),
        F.sum("imputed").alias("imputed"),
    )


def with_means(sums: DataFrame, older: bool = False) -> DataFrame:
    """Adds ``minutes``: what the rows of each sum count together; missing ones count nothing.

    Means are taken over all rows with minutes, newborns included. They are windows over the sums, so
    no second branch reads the patient-days: first each sum meets its own ward, then sums that wait
    for the ward of the previous row meet that one.
    """

    def mean(key: str, wert: Column, known: Column) -> Column:
        ward = Window.partitionBy(key)
        return F.try_divide(F.sum(wert).over(ward), F.sum(known).over(ward))

    later = F.col("kind") == "later"
    own = sums.withColumn("mean", mean("ward", F.col("wert"), F.col("n_wert")))
    gives = F.struct(F.col("ward").alias("mean_ward"), "wert", "n_wert", (~later).alias("counts"))
    nothing = F.lit(None)
    asks = F.struct(
        F.col("ward_before").alias("mean_ward"),
        nothing.cast("double").alias("wert"),
        nothing.cast("bigint").alias("n_wert"),
        F.lit(True).alias("counts"),
    )
    roles = F.explode(F.when(later, F.array(gives, asks)).otherwise(F.array(gives)))
    kept = [name for name in own.columns if name not in ("wert", "n_wert")]
    met = own.select(*kept, roles.alias("role")).select(*kept, "role.*")
    met = met.withColumn("mean_met", mean("mean_ward", F.col("wert"), F.col("n_wert"))).filter("counts")

    day = F.when(F.col("is_missing"), F.col("known") + F.col("n_own") * F.col("mean")).otherwise(F.col("known"))
    each = (F.col("fixed_before") + F.col("mean_met")) * F.col("discharge")
    added = F.col("own") if older else F.lit(0.0)
    counted = F.col("n_own") if older else F.col("n")
    minutes = (
        F.when(F.col("kind") == "day", day)
        .when(F.col("kind") == "share", added + F.col("share"))
        .when(later & (each > 0), added + counted * each)
        .when(later & (each <= 0), day)
    )
    return met.withColumn("minutes", minutes)


def ward_totals(sums: DataFrame, newborns: DataFrame | None, settings: Settings) -> DataFrame:
    """Minutes, midnight census, imputed days and patient-days per merged ward and day.

    ``sums`` are those ``with_means``; ``newborns``, the newborns' flat-rate days, take the place of the rows of their cases.
    """
    names = ["ward", "tag", "minutes", "nights", "imputed", "n"]
    parts = sums.select(*names)
    if newborns is not None:
        parts = sums.filter(~F.col("is_newborn")).select(*names)
        flat = newborns.groupBy("ward", "tag").agg(
            F.sum("gesamtwert").alias("minutes"),
            F.sum("nachts_da").alias("nights"),
            F.sum("imputed").alias("imputed"),
            F.count(F.lit(1)).alias("n"),
        )
        parts = parts.unionByName(flat)
    return parts.groupBy(
        merged_ward(F.col("ward"), settings.ward_merge).alias("Station2"), F.col("tag").alias("Tag")
    ).agg(
        sum_or_zero(F.col("minutes")).alias("ppr_tag"),
        sum_or_zero(F.col("nights")).alias("Patienten_mitternacht"),
        F.sum("imputed").alias("Fehlende_Tageswerte"),
        F.sum("n").alias("Patiententage"),
    )
