"""Registered queries about copies: near-duplicates, fingerprints, benchmark passages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fingerprints, near_duplicates
from .common import small_side, stored, table

ORACLE: dict[str, str] = {}

SHINGLE = 4
BITS = 4
WINDOW = 13
RADIUS = 3
NEAR = decontamination.Near(missing_percent=20, slack=1)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    docs = table(spark, sf_dir, "documents")
    found = near_duplicates.near_duplicates(docs, "doc_id", "text", SHINGLE, BITS)
    return found.select("doc_id", fingerprints.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike it, the edit and the next are.

    n_near, for ids divisible by 20: the number of other documents within 3 bits. Null text is
    empty. Rows of equal id and text count once in the order of documents and come back as often
    as they are.
    """
    text = F.coalesce("text", F.lit(""))
    nothing = F.col("doc_id").isNull()
    docs = table(spark, sf_dir, "documents").select(
        F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("k0"),
        F.xxhash64(text).alias("k1"),
        F.hash(text, nothing).alias("k2"),
        nothing.alias("nothing"),
        text.alias("text"),
    )
    keys = ["k0", "k1", "k2"]
    ahead = [f"next_{k}" for k in keys]
    rows = stored(docs.groupBy(*keys, "nothing", F.char_length("text").cast("long").alias("n_chars")).agg(F.count("*").alias("copies")), "documents")
    order = stored(fingerprints.followers(rows, keys), "followers")
    own = stored(fingerprints.fingerprints(docs, keys, "text"), "fingerprints")

    take = F.floor(F.col("n_chars") / 4).cast("int")
    wanted = order.join(rows, keys).select(*keys, *ahead, "n_chars", take.alias("take"))
    texts = docs.select(*keys, "text")
    heads = wanted.join(texts.toDF(*ahead, "text"), ahead).select(*keys, "n_chars", "take", F.substring("text", F.lit(1), F.col("take")).alias("head"))
    heads = heads.dropDuplicates(keys)
    edit = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("take")).cast("int")), "head")
    edited = texts.join(heads, keys).select(*keys, edit.alias("edited")).withColumn("edited_sha256", F.sha2("edited", 256))
    edited = fingerprints.fingerprints(edited, [*keys, "edited_sha256"], "edited")
    edited = stored(edited.withColumnRenamed("fingerprint", "edited_fingerprint"), "edited")

    asked = own.where("k0 % 20 = 0").select("fingerprint")
    near = fingerprints.near_fingerprints(asked, own.select("fingerprint"), RADIUS)
    sizes = own.join(rows, keys).groupBy("fingerprint").agg(F.sum("copies").alias("n"))
    counts = near.join(sizes, "fingerprint").groupBy("query").agg((F.sum("n") - 1).alias("n_near"))
    counts = small_side(stored(counts.withColumnRenamed("query", "fingerprint"), "near"))

    after = own.toDF(*ahead, "next_fingerprint")
    wide = rows.join(order, keys).join(own, keys).join(edited, keys).join(after, ahead)
    asking = wide.where("k0 % 20 = 0").join(counts, "fingerprint", "left")
    other = wide.where("k0 % 20 <> 0").withColumn("n_near", F.lit(None).cast("long"))
    every = asking.unionByName(other)
    return every.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        F.when(~F.col("nothing"), F.col("k0")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        fingerprints.hex_digits(F.col("fingerprint")).alias("fingerprint"),
        fingerprints.hex_digits(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        "n_near",
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside occurrences of 13-word windows of benchmark items.

    n_near and n_near_items: words of the document near their places in windows of which at least
    four fifths of the words stand at most one word from their places, and the items of these windows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contamination(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text", WINDOW, NEAR)
    return decontamination.with_contamination(docs, "text", found).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        "n_near",
        "n_near_items",
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op7_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
i AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w, array_to_string(words[s:s + w - 1], ' ') AS phrase
  FROM (SELECT item_id, words, least({WINDOW}, len(words)) AS w, unnest(range(1, len(words) - least({WINDOW}, len(words)) + 2)) AS s
        FROM i WHERE len(words) > 0)),
grams AS (
  SELECT r, w, s, array_to_string(words[s:s + w - 1], ' ') AS phrase
  FROM (SELECT r, words, w, unnest(range(1, len(words) - w + 2)) AS s
        FROM d JOIN (SELECT DISTINCT w FROM windows) ON len(words) >= w)),
hits AS (SELECT r, item_id, w, s FROM grams JOIN windows USING (w, phrase)),
covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + w)) AS p FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits) GROUP BY r),
texts AS (SELECT row_number() OVER () AS t, words FROM (SELECT DISTINCT words FROM i WHERE len(words) > 0)),
places AS (SELECT t, len(words) AS l, least({WINDOW}, len(words)) AS w, unnest(words) AS word, unnest(range(len(words))) AS o FROM texts),
postings AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS p FROM d),
aligned AS (
  SELECT r, t, l, w, o, p, a
  FROM (SELECT r, t, l, w, o, p, unnest(range(p - o - {NEAR.slack}, p - o + {NEAR.slack} + 1)) AS a
        FROM postings JOIN places USING (word))),
near_windows AS (
  SELECT r, t, a, s, w
  FROM (SELECT DISTINCT r, t, a, w, o, unnest(range(greatest(0, o - w + 1), least(o, l - w) + 1)) AS s FROM aligned)
  GROUP BY r, t, a, s, w HAVING count(*) >= w - w * {NEAR.missing_percent} // 100),
near_places AS (SELECT DISTINCT r, t, a, unnest(range(s, s + w)) AS o FROM near_windows),
near_hits AS (SELECT r, count(DISTINCT p) AS n_near FROM aligned SEMI JOIN near_places USING (r, t, a, o) GROUP BY r),
near_items AS (
  SELECT r, count(*) AS n_near_items
  FROM (SELECT DISTINCT r, item_id FROM near_windows JOIN texts USING (t) JOIN i USING (words)) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated,
  coalesce(n_near, 0)::BIGINT AS n_near, coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r) LEFT JOIN near_hits USING (r) LEFT JOIN near_items USING (r)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op5_simhash_near_dedup, op6_document_fingerprints, op7_decontamination)
}
