"""Ordered scans within a case.

One pass in each direction answers all questions about neighbours. All frames run from the start of
the window to the current row, so the cost is linear and nothing is buffered; "next value" is a
running frame over the reversed order.

Windows run per ``scan_key``: a case, or a piece of a large one. One summary row per piece carries
values across the cuts, and the result is the same as for whole cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pflegetakt.operators.skew import HotCases, with_scan_key

ORDER = ("tag", "ord", "cls_ord")
STATE = ("tag", "iso", "ward", "code")


def _running(*columns):
    window = Window.partitionBy("scan_key").orderBy(*columns)
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _carries(keyed: DataFrame, hot: HotCases) -> DataFrame:
    """What the pieces of a case know of one another; a few rows of large cases only."""
    position = F.struct(*ORDER)
    known_at = F.when(F.col("code").isNotNull(), position)
    pieces = (
        keyed.filter(hot.found & F.col("piece").isNotNull())
        .groupBy("case_key", "piece", "scan_key")
        .agg(
            F.min_by("code", known_at).alias("head"),
            F.max_by("code", known_at).alias("tail"),
            F.min("tag").alias("low"),
            F.max("tag").alias("high"),
            F.max_by(F.struct(*STATE), position).alias("end"),
        )
    )
    whole = Window.partitionBy("case_key")
    before = whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    after = whole.orderBy(F.col("piece").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select(
        "scan_key",
        F.last("head", ignorenulls=True).over(after).alias("carry_next"),
        F.last("tail", ignorenulls=True).over(before).alias("carry_prev"),
        F.min("low").over(whole).alias("carry_first"),
        F.max("high").over(whole).alias("carry_last"),
        F.lag("end").over(whole.orderBy("piece")).alias("carry_row"),
    )


def scan_cases(days: DataFrame, hot: HotCases) -> DataFrame:
    """Adds neighbours and bounds of each row in the order of its case.

    ``next_known`` and ``prev_known`` are the nearest known codes at or after and at or before the row,
    ``first_day`` and ``last_day`` the days of the case, ``before`` the previous row's day, isolation
    mark, ward and code (missing on the first row); the code is the previous row's own, or the one it
    is filled with: what this row sees next, else what it saw last.
    """
    keyed = with_scan_key(days, hot)
    back = _running(*[F.col(name).desc() for name in ORDER])
    forth = _running(*ORDER)
    lagging = Window.partitionBy("scan_key").orderBy(*ORDER)
    scanned = keyed.withColumns(
        {
            "next_known": F.last("code", ignorenulls=True).over(back),
            "last_day": F.max("tag").over(back),
        }
    ).withColumns(
        {
            "prev_known": F.last("code", ignorenulls=True).over(forth),
            "first_day": F.min("tag").over(forth),
            "before": F.lag(F.struct(*STATE)).over(lagging),
        }
    )
    carried = scanned.join(F.broadcast(_carries(keyed, hot)), "scan_key", "left").withColumns(
        {
            "next_known": F.coalesce("next_known", "carry_next"),
            "prev_known": F.coalesce("prev_known", "carry_prev"),
            "first_day": F.coalesce("carry_first", "first_day"),
            "last_day": F.coalesce("carry_last", "last_day"),
            "before": F.coalesce("before", "carry_row"),
        }
    )
    filled = F.coalesce("before.code", "next_known", "prev_known").alias("code")
    state = F.struct("before.tag", "before.iso", "before.ward", filled)
    return carried.withColumn("before", F.when(F.col("before").isNotNull(), state)).drop(
        "carry_next", "carry_prev", "carry_first", "carry_last", "carry_row"
    )
