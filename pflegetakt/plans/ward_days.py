"""Ward master data, ward-day workload and night staffing."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pflegetakt.functions.missing import if_known, ratio, strict_sum, sum_or_zero
from pflegetakt.operators.lookups import merged_ward
from pflegetakt.settings import Settings


def ward_master(wards: DataFrame, settings: Settings, with_quota: bool = True) -> DataFrame:
    """Master data per merged ward: beds summed, other attributes as group keys.

    Merged wards whose attributes differ keep one row each; ``split_wards`` finds
    them. Older rules group without the night quota.
    """
    quota = ["nachtdienst_quote"] if with_quota else []
    merged = wards.withColumn("Station2", merged_ward(F.col("ward"), settings.ward_merge))
    return (
        merged.groupBy("Station2", "kategorie", "ausfall1", "ausfall2", "ausfall3", *quota)
        .agg(strict_sum(F.col("betten")).alias("betten"))
        .withColumns(
            {
                "ausfallzeit": F.col("ausfall1") + F.col("ausfall2") + F.col("ausfall3"),
                "arbeitszeit_monat": F.lit(settings.minutes_per_month),
                "arbeitszeit_tag_vk": F.lit(settings.minutes_per_day),
            }
        )
    )


def split_wards(master: DataFrame) -> DataFrame:
    """Merged wards with more than one master row; they multiply every ward-day."""
    return master.groupBy("Station2").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def ward_totals(days: DataFrame, settings: Settings) -> DataFrame:
    """Minutes, midnight census, imputed days and patient-days per ward and day."""
    return days.groupBy(
        merged_ward(F.col("ward"), settings.ward_merge).alias("Station2"), F.col("tag").alias("Tag")
    ).agg(
        sum_or_zero(F.col("gesamtwert")).alias("ppr_tag"),
        sum_or_zero(F.col("nachts_da")).alias("Patienten_mitternacht"),
        strict_sum(F.col("imputed")).alias("Fehlende_Tageswerte"),
        F.count(F.lit(1)).alias("Patiententage"),
    )


def with_master(totals: DataFrame, master: DataFrame, columns: Collection[str]) -> DataFrame:
    """Left join to ward attributes; an unknown ward keeps its rows."""
    attributes = master.select(F.col("Station2").alias("master_ward"), *columns)
    return totals.join(
        attributes, F.col("Station2").eqNullSafe(F.col("master_ward")), "left"
    ).drop("master_ward")


def with_quota_nights(totals: DataFrame, master: DataFrame, settings: Settings) -> DataFrame:
    """Full-time posts by day, and by night from the census per night nurse.

    At least one nurse is on duty. A quota of zero gives missing night values.
    """
    nurses = ratio(F.col("Patienten_mitternacht"), F.col("nachtdienst_quote"))
    minutes = F.lit(settings.night_minutes)
    night = if_known(nurses < 1, minutes, nurses * minutes)
    return with_master(totals, master, ["arbeitszeit_tag_vk", "nachtdienst_quote"]).withColumns(
        {
            "VK_tag": F.col("ppr_tag") / F.col("arbeitszeit_tag_vk"),
            "Minuten_nacht": night,
            "VK_nacht": night / F.col("arbeitszeit_tag_vk"),
        }
    )


def _night_row(totals: DataFrame, night: DataFrame) -> DataFrame:
    """The lookup row of the midnight census; missing outside the table.

    The keys are numbers, not counts: a row for 12.6 belongs to no census.
    """
    rows = night.withColumn("patienten", F.col("patienten").cast("double"))
    census = F.col("Patienten_mitternacht").cast("double")
    return totals.join(rows, census.eqNullSafe(F.col("patienten")), "left").drop("patienten")


def _obstetric(settings: Settings, wards: Collection[str] | None) -> Column:
    return F.col("Station2").isin(*(wards if wards is not None else [settings.newborn_ward]))


def with_lookup_nights(
    totals: DataFrame,
    night: DataFrame,
    master: DataFrame,
    settings: Settings,
    obstetric_wards: Collection[str] | None = None,
) -> DataFrame:
    """Night minutes from a table of census values; obstetric wards have a column
    of their own."""
    rows = with_master(_night_row(totals, night), master, ["arbeitszeit_tag_vk"])
    minutes = if_known(
        _obstetric(settings, obstetric_wards), F.col("min_ex_geb_net"), F.col("min_ex_net")
    )
    return rows.withColumns(
        {
            "Minuten_nacht": minutes,
            "VK_tag": F.col("ppr_tag") / F.col("arbeitszeit_tag_vk"),
            "VK_nacht": minutes / F.col("arbeitszeit_tag_vk"),
        }
    ).drop("min_ex_net", "min_hilf_net", "min_ex_geb_net")


def with_qualification(
    totals: DataFrame,
    night: DataFrame,
    helper_share: Column,
    settings: Settings,
    obstetric_wards: Collection[str] | None = None,
) -> DataFrame:
    """Minutes of examined nurses and of helpers, day and night together.

    The share goes to the examined nurses and its rest to the helpers, whatever
    the key's name suggests.
    """
    examined_night = if_known(
        _obstetric(settings, obstetric_wards), F.col("min_ex_geb_net"), F.col("min_ex_net")
    )
    return (
        _night_row(totals, night)
        .withColumns(
            {
                "Minuten_exam_gesamt": F.col("ppr_tag") * helper_share + examined_night,
                "Minuten_hilf_gesamt": F.col("ppr_tag") * (1 - helper_share) + F.col("min_hilf_net"),
            }
        )
        .drop("min_ex_net", "min_hilf_net", "min_ex_geb_net")
    )
