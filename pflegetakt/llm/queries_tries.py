"""Registered queries over words, conversation prefixes and repeated bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import prefix_trie, repeats, spelling
from .common import stored, table

ORACLE: dict[str, str] = {}

LEAST_LETTERS = 6
LEAST_COUNT = 5
MARKED = 199
RATIO = 5


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, variant form and root of every word of at least 6 letters and 5 occurrences."""
    docs = table(spark, sf_dir, "documents")
    runs = docs.select("doc_id", F.explode(spelling.words_of(F.col("text"))).alias("run"))
    read = runs.select(spelling.without_marked_letter(F.col("run"), F.col("doc_id"), MARKED).alias("word"))
    words = stored(spelling.count_words(read, "word", LEAST_LETTERS, LEAST_COUNT), "words")
    return spelling.variant_groups(words, spelling.near_words(words, LEAST_LETTERS), RATIO)


# DuckDB has no CRC-32: the table of the reflected polynomial 0xEDB88320 is built by eight halvings of each byte.
_CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v
    FROM (SELECT unnest(range(256)) AS b)))"""

_CRC = """xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(length(hx) // 2), lambda i: ('0x' || hx[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1])))"""

ORACLE["op11_spelling_variants"] = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{spelling.WORD}')) AS run
    FROM documents) GROUP BY ALL),
hexed AS (SELECT doc_id, run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM runs),
hashed AS (
  SELECT doc_id, run, n, {_CRC} AS h
  FROM hexed, crc_table),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {MARKED} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
less AS (
  SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
near AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top FROM pairs GROUP BY word),
best AS (SELECT p.word, min(other) AS other, max(other_n) AS other_n, max(n_near) AS n_near FROM pairs p JOIN near ON near.word = p.word AND top = other_n GROUP BY p.word),
forms AS (
  SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN other_n >= {RATIO} * n THEN other END AS form, CASE WHEN other_n >= {RATIO} * n THEN other_n END::BIGINT AS form_n
  FROM words LEFT JOIN best ON best.word = words.word),
walk AS (
  SELECT word, word AS reached, 0 AS step FROM forms
  UNION ALL SELECT walk.word, form, step + 1 FROM walk JOIN forms ON forms.word = walk.reached WHERE form IS NOT NULL),
roots AS (SELECT word, arg_max(reached, step) AS root FROM walk GROUP BY word)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""

GROUP = 20
MOST_LENT = 3


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prefix nodes of the rebuilt conversations."""
    numbered = stored(prefix_trie.numbered_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text"), "numbered")
    turns, members = prefix_trie.regrafted(numbered, GROUP, MOST_LENT)
    return prefix_trie.prefix_trie(turns, members)


ORACLE["op12_prefix_trie"] = rf"""
WITH {_CRC_TABLE},
turns AS (
  SELECT conv_id, turn, coalesce(text, '') AS said, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d
  FROM conversations WHERE conv_id IS NOT NULL),
ordered AS (SELECT conv_id, said, d, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos FROM turns),
sizes AS (
  SELECT conv_id, conv_id - conv_id % {GROUP} AS base, n, {_CRC} % {MOST_LENT + 1} AS h
  FROM (SELECT conv_id, max(pos) AS n, hex(encode(conv_id::VARCHAR)) AS hx FROM ordered GROUP BY conv_id), crc_table),
members AS (SELECT s.conv_id, s.base, s.n, s.h, least(s.h, coalesce(b.n, 0)) AS taken FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.base),
rebuilt AS (
  SELECT m.conv_id, pos AS depth, d, said FROM members m JOIN ordered o ON o.conv_id = m.base WHERE pos <= taken
  UNION ALL SELECT m.conv_id, taken + pos - h, d, said FROM members m JOIN ordered o ON o.conv_id = m.conv_id WHERE pos > h),
prefixes AS (
  SELECT conv_id, depth, sha256(string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key,
    len(regexp_extract_all(said, '{prefix_trie.WORDS}')) AS words FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', 0 FROM members),
nodes AS (SELECT depth, key, min(conv_id) AS node, count(*) AS n_convs, max(words) AS words FROM prefixes GROUP BY depth, key),
path AS (SELECT conv_id, depth, node FROM prefixes JOIN nodes USING (depth, key)),
linked AS (SELECT n.depth, n.node, n.n_convs, n.words, p.node AS parent FROM nodes n LEFT JOIN path p ON p.conv_id = n.node AND p.depth = n.depth - 1),
fans AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
own AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN fans USING (depth, node)),
sums AS (
  SELECT p.depth, p.node, count(*) FILTER (o.n_children = 0) AS n_leaves, sum((o.n_convs - 1) * o.words)::BIGINT AS saved_tokens
  FROM own o JOIN path p ON p.conv_id = o.node AND p.depth <= o.depth GROUP BY ALL),
ends AS (
  SELECT depth, node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM path WHERE (conv_id, depth) IN (SELECT conv_id, max(depth) FROM path GROUP BY conv_id) GROUP BY ALL)
SELECT node AS conv_id, depth::BIGINT AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM own JOIN sums USING (depth, node) LEFT JOIN ends USING (depth, node)
"""

REPEAT = 100


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less the bytes covered by a 100-byte string that also starts earlier."""
    docs = repeats.keyed(table(spark, sf_dir, "documents"), "doc_id", "text")
    return repeats.cut_repeats(docs, stored(repeats.repeat_marks(docs, REPEAT), "marks"))


ORACLE["op13_suffix_array_dedup"] = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
strings AS (
  SELECT r, s, md5(hx[2 * s + 1:2 * s + {2 * REPEAT}]) AS m
  FROM (SELECT r, hx, unnest(range(0, length(hx) // 2 - {REPEAT - 1})) AS s FROM d)),
starts AS (SELECT r, s FROM (SELECT r, s, row_number() OVER (PARTITION BY m ORDER BY r, s) AS nth FROM strings) WHERE nth > 1),
edges AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + {REPEAT} THEN 0 ELSE 1 END AS opens FROM starts),
spans AS (
  SELECT r, min(s) AS a, max(s) + {REPEAT} AS b
  FROM (SELECT r, s, sum(opens) OVER (PARTITION BY r ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM edges) GROUP BY r, k),
gaps AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS gap FROM (SELECT * FROM spans UNION ALL SELECT r, length(hx) // 2, length(hx) // 2 FROM d)),
kept AS (SELECT r, string_agg(hx[2 * gap + 1:2 * a], '' ORDER BY a, b) AS hx FROM gaps JOIN d USING (r) GROUP BY r),
removed AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, (length(d.hx) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(kept.hx)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN removed USING (r)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op11_spelling_variants, op12_prefix_trie, op13_suffix_array_dedup)}
