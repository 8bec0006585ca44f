"""Large cases, cut into ordered pieces.

A placeholder case can hold a large share of all rows and would land in one task. Such cases are
found, sampled and cut inside the plan: nothing is counted or written while a plan is built.

A case is large above ``max_case_days`` days and above one in ``MOST_HOT`` of all days, so there are
fewer than ``MOST_HOT`` of them whatever the data. Days of their stays are sampled by a hash, and every
``SAMPLES``-th sampled position (day, row order) starts a new piece: pieces hold about half the limit,
and all large cases together have at most some 2 * ``MOST_HOT``. Positions are only compared, so the row
order can be a number, a text or a struct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pflegetakt.settings import Settings

MOST_HOT = 2_000
SAMPLES = 64
_SEARCH_BITS = 14


@dataclass(frozen=True)
class HotCases:
    """``cuts``: case_key and its sorted first positions of pieces; ``found``: whether there is any."""

    cuts: DataFrame
    found: Column


def _days() -> Column:
    return F.date_diff("end_day", "begin_day") + 1


def hot_cases(spans: DataFrame, settings: Settings) -> HotCases:
    """Large cases of valid stays.

    A case has at most one patient-day per stay and calendar day, so the sum of stay lengths bounds
    its size from above.
    """
    total = spans.agg(F.coalesce(F.sum(_days()), F.lit(0))).scalar()
    limit = F.greatest(F.lit(settings.max_case_days), F.floor(total / MOST_HOT))
    sizes = spans.groupBy("case_key").agg(F.sum(_days()).alias("days")).withColumn("limit", limit)
    every = F.greatest(F.lit(1), F.floor(F.col("limit") / (2 * SAMPLES)))
    hot = sizes.filter("days > limit").select("case_key", every.alias("every"))
    position = F.struct("tag", "ord")
    sampled = (
        spans.join(F.broadcast(hot), "case_key")
        .select("case_key", "every", "ord", F.explode(F.sequence("begin_day", "end_day")).alias("tag"))
        .filter(F.pmod(F.xxhash64("ord", "tag"), F.col("every")) == 0)
    )
    positions = sampled.groupBy("case_key").agg(F.sort_array(F.collect_list(position)).alias("positions"))
    nth = F.filter("positions", lambda _, i: i % SAMPLES == SAMPLES - 1)
    cuts = positions.select("case_key", nth.alias("cuts"))
    return HotCases(cuts, hot.agg(F.count(F.lit(1)) > 0).scalar())


def _piece(cuts: Column, position: Column) -> Column:
    """Number of cuts at or before the position, by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(_SEARCH_BITS))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get(cuts, at + step - 1) <= position, at + step).otherwise(at),
    )


def _scan_key(case_key: Column, piece: Column) -> Column:
    """An ordinary case's own key; keys of pieces begin with a sign that no case key begins with."""
    return F.concat(F.lit("#"), piece.cast("string"), F.lit(":"), case_key)


def with_scan_key(days: DataFrame, hot: HotCases) -> DataFrame:
    """Adds ``scan_key``, the key of a case or of a piece of a large one, and ``piece``."""
    marked = days.join(F.broadcast(hot.cuts), "case_key", "left")  # fewer than MOST_HOT rows
    piece = F.when(F.col("cuts").isNotNull(), _piece(F.col("cuts"), F.struct("tag", "ord")))
    marked = marked.withColumn("piece", piece).drop("cuts")
    key = F.coalesce(_scan_key(F.col("case_key"), F.col("piece")), F.col("case_key"))
    return marked.withColumn("scan_key", key)


def scan_keys(cases: DataFrame, hot: HotCases) -> DataFrame:
    """All ``scan_key`` values of the given cases, to meet days on the shuffle of their windows."""
    marked = cases.join(F.broadcast(hot.cuts), "case_key", "left")
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("cuts")), lambda p: _scan_key(F.col("case_key"), p)
    )
    keys = F.when(F.col("cuts").isNull(), F.array("case_key")).otherwise(pieces)
    return marked.select("case_key", F.explode(keys).alias("scan_key"))
