"""Row filters, de-duplication and day expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_prefix(df: DataFrame, pattern: str, column: str | None = None) -> DataFrame:
    """Rows whose text matches; the first column by position unless one is named."""
    return df.filter(F.col(f"`{column or df.columns[0]}`").rlike(pattern))


def keep_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last row per key in the given order; missing keys form one group.

    ``order`` must be unique and never null within a key. The aggregate keeps
    one row per key and map task before the shuffle, so a key that holds a large
    share of all rows sends only a few of them.
    """
    rest = [name for name in df.columns if name not in keys]
    last = F.max_by(F.struct(*rest), F.col(order)).alias("last_row")
    return df.groupBy(*keys).agg(last).select(*keys, "last_row.*")


def preview(df: DataFrame, order: Sequence[str | Column], rows: int = 6) -> DataFrame:
    """First rows in the given order."""
    return df.orderBy(*order).limit(rows)


def forward_spans(df: DataFrame, begin: str, end: str) -> DataFrame:
    """Rows whose span can be expanded; drops open and reversed spans."""
    return df.filter(F.col(begin) <= F.col(end))


def reversed_spans(df: DataFrame, begin: str, end: str) -> DataFrame:
    """Reject table: spans that end before they begin."""
    return df.filter(F.col(begin) > F.col(end))


def visible_spans(df: DataFrame, key: str, begin: str, end: str, order: str) -> DataFrame:
    """Spans of days cut so that none of a key overlap; on each day the span of the last row wins.

    The bounds of all spans of a key divide its time into pieces on which no span begins or ends. A
    span is dealt into its pieces, and each piece goes to the last row. Most spans meet no other and
    stay whole, or are cut once, so rows are about as many as spans, not days.

    Of spans with equal bounds only the last can be seen, and they are combined before the shuffle:
    a key that holds a large share of all rows is left with one row for each pair of bounds.
    ``order`` must be unique and never null within a key; missing keys form one group.
    """
    rest = [name for name in df.columns if name not in (key, begin, end)]
    last = F.max_by(F.struct(*rest), F.col(order)).alias("row")
    latest = df.groupBy(key, begin, end).agg(last)
    bounds = F.explode(F.array(F.col(begin), F.date_add(end, 1))).alias("bound")
    points = df.select(key, bounds).groupBy(key).agg(F.sort_array(F.collect_set("bound")).alias("points"))
    starts = F.filter("points", lambda p: (p >= F.col(begin)) & (p <= F.col(end)))
    nexts = F.filter("points", lambda p: (p > F.col(begin)) & (p <= F.date_add(end, 1)))
    pieces = (
        latest.join(points, key)
        .select(key, "row", F.explode(F.arrays_zip(starts.alias("start"), nexts.alias("next"))).alias("piece"))
        .groupBy(key, F.col("piece.start").alias(begin))
        .agg(F.max_by(F.struct("row", "piece.next"), F.col(f"row.{order}")).alias("seen"))
    )
    return pieces.select(key, "seen.row.*", begin, F.date_sub("seen.next", 1).alias(end))


def expand_days(df: DataFrame, begin: str, end: str, out: str = "tag") -> DataFrame:
    """One row per calendar day of a span, both ends included.

    Spans become months and months become days, so no array holds the days of a whole span.
    """
    kept = [name for name in df.columns if name not in (begin, end)]
    first = F.sequence(F.trunc(begin, "month"), F.col(end), F.expr("interval 1 month"))
    months = forward_spans(df, begin, end).select(*df.columns, F.explode(first).alias("span_month"))
    days = F.sequence(F.greatest(begin, "span_month"), F.least(F.col(end), F.last_day("span_month")))
    return months.select(*kept, F.explode(days).alias(out))


def long_spans(df: DataFrame, begin: str, end: str, days: int) -> DataFrame:
    """Spans of more than that many days, both ends included, with their ``days``."""
    length = F.date_diff(F.col(end), F.col(begin)) + 1
    return df.filter(length > days).withColumn("days", length)
