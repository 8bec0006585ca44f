"""Line de-duplication relative to the site: lines most pages of a host repeat are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small_side, stored

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
HIDDEN = r"(?is)<(?:script|style)[^<>]*>.*?</(?:script|style)[^<>]*>"
BREAKS = (
    r"(?i)</?(?:html|head|title|body|nav|ul|ol|li|div|article|section|header|footer|h[1-6]|p|br|table|tr|td)"
    r"(?:[ \t\r\n][^<>]*)?/?>"
)
MARKUP = r"<[^<>]*>"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty for null or other texts, which then form a host of their own."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def page_lines(html: Column) -> Column:
    """Visible lines of a page: block tags and line feeds end lines, blank lines go. Null: none."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), MARKUP, "")
    lines = F.split(F.translate(text, "\r\t", "\n "), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def _mark(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate_lines(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(host, lines): marks (96 hash bits) of the lines on more than `ratio` of a host's pages.

    Every page counts a line once. Hosts of under `min_pages` pages give no evidence. The list
    of a host has at most (mean lines a page) / ratio entries, however many pages it has.
    """
    seen = F.array_distinct(F.transform(F.col("lines"), _mark))
    marks = pages.select("host", F.explode(seen).alias("mark")).groupBy("host", "mark").agg(F.count("*").alias("n"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    often = marks.where(F.col("n") > ratio * min_pages).join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("mark").alias("often"))


def drop_site_lines(
    pages: DataFrame,
    id_col: str,
    host: Column,
    lines: Column,
    ratio: float = 0.3,
    min_pages: int = 5,
    spread: int = 16,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(id, host, lines, kept): each page's lines, and those that are no boilerplate of its host.

    A line goes if more than `ratio` of its host's pages contain it. Counts are combined before
    the shuffle. The hosts' lists are broadcast if counted small; else they are repeated `spread`
    times and pages meet them by host and a salt, so a host holding a third of all pages is
    split. Null host: the host ""; null or empty lines: none; repeated rows count as pages of
    their own and all come back; further columns are not read.
    """
    own = pages.select(
        F.col(id_col).alias(id_col), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(lines, F.array()).alias("lines")
    )
    often = small_side(stored(boilerplate_lines(own, ratio, min_pages), "site-lines"), broadcast_rows)
    salted = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    own = own.withColumn("salt", F.pmod(F.xxhash64(id_col, "lines"), F.lit(spread)).cast("int"))
    kept = F.filter("lines", lambda x: ~F.coalesce(F.array_contains("often", _mark(x)), F.lit(False)))
    return own.join(salted, ["host", "salt"], "left").select(id_col, "host", "lines", kept.alias("kept"))
