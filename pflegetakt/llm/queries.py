"""Registered queries of the corpus operators: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, langid, lines, queries_copies, queries_models, queries_tries, sharding
from .common import held_out, table

ORACLE: dict[str, str] = {**queries_copies.ORACLE, **queries_models.ORACLE, **queries_tries.ORACLE}


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without the lines that over 30 % of their host's pages repeat."""
    pages = table(spark, sf_dir, "pages")
    out = lines.drop_site_lines(pages, "page_id", lines.host_of(F.col("url")), lines.page_lines(F.col("html")))
    return out.select(
        "page_id",
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept_text"),
    )


ORACLE["op2_line_dedup"] = rf"""
WITH own AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{lines.HOST}', 1)) AS host,
    list_filter(list_transform(string_split(translate(
      regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{lines.HIDDEN}', chr(10), 'g'),
        '{lines.BREAKS}', chr(10), 'g'), '{lines.MARKUP}', '', 'g'), chr(13) || chr(9), chr(10) || ' '), chr(10)),
      lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages),
counts AS (
  SELECT host, line, count(*) AS n
  FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM own) GROUP BY ALL),
totals AS (SELECT host, count(*) AS pages FROM own GROUP BY host),
often AS (
  SELECT host, list(line) AS often FROM counts JOIN totals USING (host)
  WHERE pages >= 5 AND n > 0.3 * pages GROUP BY host),
done AS (
  SELECT page_id, own.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(often, []), x)) AS kept
  FROM own LEFT JOIN often USING (host))
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
  array_to_string(kept, chr(10)) AS kept_text
FROM done
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by jump consistent hashing of doc_id."""
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = sharding.assign_shards(rows, ["doc_id"], 16, "shard", "grown_shard")
    numbered = sharding.number_within_shards(placed, ["doc_id"], "text_crc32", "shard", "slot")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back through their verified boundaries."""
    back = archives.round_trip(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    train = docs.where(~held_out(F.col("doc_id")))
    filters = langid.fit_language_filters(train, "doc_id", "text", "lang")
    marked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return langid.predict_language(marked, filters, ["doc_id", "held_out"], "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f.__name__: f for f in (op2_line_dedup, op3_sharding, op9_warc, op10_language_id)},
    **queries_copies.QUERIES,
    **queries_models.QUERIES,
    **queries_tries.QUERIES,
}
