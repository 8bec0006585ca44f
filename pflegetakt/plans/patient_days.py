"""Stays and classifications to one row per patient and day."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pflegetakt.functions.dates import parse_day
from pflegetakt.functions.missing import if_known, key_text, key_value
from pflegetakt.operators.case_scan import scan_cases
from pflegetakt.operators.lookups import rate_lists, rate_lookup
from pflegetakt.operators.rows import (
    expand_days,
    forward_spans,
    long_spans,
    match_prefix,
    reversed_spans,
    visible_spans,
)
from pflegetakt.operators.skew import HotCases
from pflegetakt.settings import Settings


def with_ids(df: DataFrame) -> DataFrame:
    """Patient and case numbers in place of their join keys."""
    named = {"pid_key": "pid", "case_key": "case_id"}
    return df.select(
        *[
            key_value(F.col(name)).alias(named[name]) if name in named else F.col(name)
            for name in df.columns
        ]
    )


# Stays


def admitted_stays(stays: DataFrame, settings: Settings) -> DataFrame:
    """Stays on a ward, admitted in the period; open and reversed ones included."""
    if settings.require_ward:
        stays = stays.filter(F.col("ward").isNotNull())
    if settings.admitted_from is not None:
        # A plain range on the stored column, so that it reaches the scan.
        stays = stays.filter(F.col("begin_ts") >= F.lit(settings.admitted_from))
    return stays.select(
        key_text(F.col("pid")).alias("pid_key"),
        key_text(F.col("case_id")).alias("case_key"),
        "ward",
        "ord",
        F.col("begin_ts").cast("date").alias("begin_day"),
        F.col("end_ts").cast("date").alias("end_day"),
    )


def valid_stays(stays: DataFrame, settings: Settings) -> DataFrame:
    """Stays that count: on a ward, admitted in the period, ended, not reversed, not too long if that matters."""
    ended = forward_spans(admitted_stays(stays, settings), "begin_day", "end_day")
    if settings.count_long_stays:
        return ended
    return ended.filter(F.date_diff("end_day", "begin_day") < settings.long_stay_days)


def long_stays(stays: DataFrame, settings: Settings) -> DataFrame:
    """Admitted stays of an unlikely length; whether they count is a setting."""
    return long_spans(admitted_stays(stays, settings), "begin_day", "end_day", settings.long_stay_days)


def rejected_stays(stays: DataFrame, settings: Settings) -> DataFrame:
    """Stays that end before they begin."""
    return reversed_spans(admitted_stays(stays, settings), "begin_day", "end_day")


def master_days(spans: DataFrame) -> DataFrame:
    """One row per patient and day; where stays overlap, the later row wins.

    Stays are cut to what is seen of them before they become days, so no day is compared with another.
    """
    seen = visible_spans(spans, "pid_key", "begin_day", "end_day", "ord")
    return expand_days(seen, "begin_day", "end_day").select("pid_key", "tag", "case_key", "ward", "ord")


# Classifications


def last_classifications(
    classifications: DataFrame, settings: Settings, extras: Sequence[str] = ()
) -> DataFrame:
    """Per patient and day text the last care category and the last isolation mark.

    Both sets come from one scan and one shuffle. ``own`` and ``iso_ord`` are
    missing where a set has no row. The de-duplication key is the day *text*: two
    layouts of one day both survive, unless ``dedupe_by_text`` is off.
    """
    is_iso = F.col("code") == settings.isolation_code
    own = F.struct("code", F.col("ord").alias("cls_ord"), *extras)
    rows = match_prefix(classifications, settings.category_pattern, "category").withColumn(
        "pid_key", key_text(F.col("pid"))
    )
    last = [
        F.max_by(F.when(~is_iso, own), F.when(~is_iso, F.col("ord"))).alias("own"),
        F.max(F.when(is_iso, F.col("ord"))).alias("iso_ord"),
    ]
    if settings.dedupe_by_text:
        return rows.groupBy("pid_key", "datum").agg(*last).withColumn("tag", parse_day(F.col("datum")))
    parsed = rows.withColumn("tag", parse_day(F.col("datum")))
    return parsed.groupBy("pid_key", "tag").agg(*last, F.max("datum").alias("datum"))


def split_isolation(
    classifications: DataFrame, settings: Settings, extras: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Care categories and isolation marks as two tables."""
    last = last_classifications(classifications, settings, extras)
    categories = last.filter(F.col("own").isNotNull()).select("pid_key", "datum", "tag", "own.*")
    isolation = last.filter(F.col("iso_ord").isNotNull()).select("pid_key", "datum", "tag", "iso_ord")
    return with_ids(categories), with_ids(isolation)


def classified_days(last: DataFrame) -> DataFrame:
    """Category rows times isolation rows per patient and day, ready for one join.

    A left join to the categories and another to the isolation marks would give
    every pairing of the day's texts. The texts of one day are a handful (day,
    month and year each have two spellings), so the pairing is made here, and the
    large side is joined once.
    """
    days = (
        last.filter(F.col("tag").isNotNull())
        .groupBy("pid_key", "tag")
        .agg(F.collect_list("own").alias("owns"), F.count("iso_ord").alias("isos"))
    )
    none = F.array(F.lit(None).cast(days.schema["owns"].dataType.elementType))
    owns = F.when(F.size("owns") == 0, none).otherwise(F.col("owns"))
    paired = F.when(
        F.col("isos") > 1, F.flatten(F.array_repeat(owns, F.col("isos").cast("int")))
    ).otherwise(owns)
    return days.select(
        "pid_key",
        "tag",
        (F.col("isos") > 0).cast("int").alias("iso"),
        F.explode(paired).alias("own"),
    ).select("pid_key", "tag", "iso", "own.*")


def attach_classifications(master: DataFrame, classified: DataFrame) -> DataFrame:
    """Patient-days with their category, if any, and the isolation flag."""
    kept = [name for name in classified.columns if name not in ("pid_key", "tag", "iso")]
    return master.join(classified, ["pid_key", "tag"], "left").select(
        *master.columns, *kept, F.coalesce("iso", F.lit(0)).alias("iso")
    )


# Imputation


def fill_categories(days: DataFrame, hot: HotCases) -> DataFrame:
    """Missing categories from the next known one of the case, else the previous."""
    scanned = scan_cases(days, hot)
    kept = [name for name in scanned.columns if name not in ("code", "next_known", "prev_known")]
    return scanned.select(
        *kept,
        F.col("code").alias("code_own"),
        F.coalesce("next_known", "prev_known").alias("code"),
    )


def rate_days(
    filled: DataFrame, controls: DataFrame, control_row: Column, control: Mapping[str, Column]
) -> DataFrame:
    """Adds minutes by category, the base value and the imputation flags.

    ``control_row`` becomes the column ``control`` that ``control`` reads from: one subquery in the plan.

    A category with several minutes gives as many rows, one after the other in the order of days;
    ``before`` is then the row before in that order, with its minutes ``wert``.
    """
    lists = rate_lists(controls)
    listed = rate_lookup(filled, lists, F.col("code"), "rates")
    listed = rate_lookup(listed, lists, F.col("before.code"), "rates_before")
    kept = [name for name in listed.columns if name not in ("rates_before", "before")]
    rows = listed.select(
        *kept,
        "rates_before",
        "before",
        control_row.alias("control"),
        F.posexplode_outer("rates").alias("rate_ord", "wert"),
    )
    repeated = F.struct("tag", "iso", "ward", F.get("rates", F.col("rate_ord") - 1).alias("wert"))
    earlier = F.struct(
        "before.tag", "before.iso", "before.ward", F.try_element_at("rates_before", F.lit(-1)).alias("wert")
    )
    return (
        rows.withColumn(
            "before",
            F.when(F.col("rate_ord") > 0, repeated).when(F.col("before").isNotNull(), earlier),
        )
        .drop("rates", "rates_before")
        .withColumns(
            {
                "pflegegrundwert": base_value(F.col("iso"), control),
                "imputed": F.col("code_own").isNull().cast("int"),
                "imputed_after_fill": F.col("wert").isNull().cast("int"),
            }
        )
    )


def base_value(isolated: Column, control: Mapping[str, Column]) -> Column:
    """Base minutes of a day, raised for an isolated patient."""
    return if_known(isolated == 1, control["raised_base"], control["base"])


def count_wards(spans: DataFrame) -> int:
    return spans.select("ward").distinct().count()


def impute_ward_mean(rated: DataFrame, wards: int, settings: Settings) -> DataFrame:
    """Minutes still missing, of the row and of the one before, become the mean of the (unmerged) ward.

    The means need a pass of their own over the rated days. Isolated and other
    days are summed apart, so that pass reads the same columns as the main one and
    Spark reuses its shuffle instead of joining twice. Reports do not need the rows:
    ``totals.ward_totals`` lets the means enter after the aggregation.
    """
    isolated = F.when(F.col("iso") == 1, F.col("wert"))
    other = F.when(F.col("iso") == 0, F.col("wert"))
    total = F.coalesce(F.sum(isolated), F.lit(0.0)) + F.coalesce(F.sum(other), F.lit(0.0))
    known = F.count(isolated) + F.count(other)
    means = rated.groupBy(F.col("ward").alias("mean_ward")).agg(
        F.try_divide(total, known).alias("mean_wert")
    )
    if wards <= settings.max_broadcast_wards:
        means = F.broadcast(means)
    means_before = means.toDF("mean_ward_before", "mean_before")
    kept = [name for name in rated.columns if name not in ("wert", "before")]
    minutes_before = F.coalesce("before.wert", "mean_before").alias("wert")
    before = F.struct("before.tag", "before.iso", "before.ward", minutes_before)
    return (
        rated.join(means, F.col("ward").eqNullSafe(F.col("mean_ward")), "left")
        .join(means_before, F.col("before.ward").eqNullSafe(F.col("mean_ward_before")), "left")
        .select(
            *kept,
            F.coalesce("wert", "mean_wert").alias("wert"),
            F.when(F.col("before").isNotNull(), before).alias("before"),
        )
    )


def stay_checks(stays: DataFrame, settings: Settings) -> DataFrame:
    """How many admitted stays count, are still open, or end before they begin.

    A begin that is missing or could not be parsed is no admission of any period; such stays
    on a ward are counted apart.
    """
    if settings.require_ward:
        stays = stays.filter(F.col("ward").isNotNull())
    begin, end = F.col("begin_ts").cast("date"), F.col("end_ts").cast("date")
    admitted = begin.isNotNull()
    if settings.admitted_from is not None:
        admitted = F.col("begin_ts") >= F.lit(settings.admitted_from)
    return stays.agg(
        F.count_if(admitted & (begin <= end)).alias("counted"),
        F.count_if(admitted & end.isNull()).alias("open"),
        F.count_if(admitted & (begin > end)).alias("reversed"),
        F.count_if(begin.isNull()).alias("without_begin"),
    )
