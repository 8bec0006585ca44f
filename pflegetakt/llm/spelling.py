"""Spelling variants: words one edit apart, found through an index of grams of variable length.

1. Gram dictionary. Every word stands between two marks. A gram of two characters is extended, one
   character at a time up to `longest`, as long as it is frequent among all words. A gram that is
   already rare is not extended: that is the pruning.
2. A word is cut into its grams: at each place the longest one, without those that lie inside an
   earlier one.
3. For each word a bound says how many of its grams a single edit can affect, wherever it happens.
   A gram is affected if the edit is inside it, or if it is right of the edit and so near that a
   gram from the left could grow over it. A gram left of the edit never is, because whether a gram
   is extended depends on its own characters. Near words share all grams but the affected.
4. So near words share one of the `affected + 1` rarest grams of each, at the same place or one
   further. Only these short lists are merged; what meets in one is verified.

No cap on lists, candidates or partners. A word of at least 2 * longest - 2 characters keeps at least
one gram whatever the edit, because its first and last gram are never affected together; a
`longest` for which this does not hold is refused.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Characters that can stand in a word, in the order of the pattern.
WORD = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BEGIN, END = "\x02", "\x03"
SHORTEST = 2

FREQUENT_GRAMS = 16_384
"""A gram is frequent above this share of all gram places, so no length has more frequent grams."""


def words_of(text: Column) -> Column:
    """Runs of letters in order, A-Z in lower case; none for a null text."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), 0)


def without_marked_letter(word: Column, doc_id: Column, every: int) -> Column:
    """The word, or the word less one letter where the crc32 of `<id>:<word>` is a multiple of `every`.

    A null id stands as the empty text in the hashed text.
    """
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.char_length(word)).cast("int")
    shorter = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))
    return F.when(h % every == 0, shorter).otherwise(word)


def count_words(words: DataFrame, word: str, min_length: int, min_count: int) -> DataFrame:
    """`word n`: words of enough characters and occurrences. Counts are combined before the shuffle."""
    long = words.where(F.char_length(word) >= min_length)
    return long.groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _counter(longest: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q in range(SHORTEST, longest):
                found = Counter()
                for word in batch.column("word").to_pylist():
                    s = BEGIN + word + END
                    found.update([s[p : p + q] for p in range(len(s) - q + 1)])
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(found), pa.int32()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["q", "gram", "n"])

    return count


def frequent_grams(words: DataFrame, longest: int, most: int = FREQUENT_GRAMS) -> list[str]:
    """Grams shorter than `longest` that are extended: above one in `most` of all gram places.

    Fewer than `most` grams of each length can be, so the list is bounded whatever the words.
    """
    rows = words.select("word").mapInArrow(_counter(longest), "q int, gram string, n long")
    counts = stored(rows.groupBy("q", "gram").agg(F.sum("n").alias("n")), "grams")
    limits = counts.groupBy("q").agg((F.sum("n") / most).alias("limit"))
    return [r["gram"] for r in counts.join(F.broadcast(limits), "q").where("n > limit").select("gram").collect()]


def grams_of(word: str, frequent: frozenset[str], longest: int) -> list[tuple[int, str]]:
    """The word between its marks as (place, gram), by rising place; none lies inside another."""
    s = BEGIN + word + END
    kept, reach = [], 0
    for p in range(len(s) - SHORTEST + 1):
        e = p + SHORTEST
        while e - p < longest and e < len(s) and s[p:e] in frequent:
            e += 1
        if e > reach:
            kept.append((p, s[p:e]))
            reach = e
    return kept


def most_affected(word: str, kept: list[tuple[int, str]], inner: frozenset[str], longest: int) -> int:
    """How many grams of the word one edit can affect at most.

    `inner` are the proper endings of frequent grams: a gram from the left can only grow over
    s[i:e] if all of it but its last character is such an ending.
    """
    s = BEGIN + word + END
    at, before = [0] * (len(s) + 1), [0] * (len(s) + 1)  # edits of the character i; insertions before i
    for p, gram in kept:
        last = p + len(gram) - 1
        for i in range(p, last + 1):
            at[i] += 1
        for i in range(p + 1, last + 1):
            before[i] += 1
        for i in range(max(0, last - longest + 2), p + 1):
            if s[i:last] in inner:  # a gram that begins left of i
                before[i] += 1
                if i:
                    at[i - 1] += 1
    return max(max(at[1 : len(s) - 1]), max(before[1 : len(s)]))


_CUT = "id long, chars int, grams int, affected int, gram string, place int"


def _cutter(frequent: list[str], longest: int):
    wanted = frozenset(frequent)
    inner = frozenset(gram[k:] for gram in frequent for k in range(1, len(gram)))
    names = ["id", "chars", "grams", "affected", "gram", "place"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist(), strict=True):
                kept = grams_of(word, wanted, longest)
                affected = most_affected(word, kept, inner, longest)
                rows.extend((key, len(word), len(kept), affected, gram, p) for p, gram in kept)
                if len(rows) >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return cut


def near_words(words: DataFrame, min_length: int, longest: int = 4, most: int = FREQUENT_GRAMS) -> DataFrame:
    """All pairs of `words` (columns word, n) that differ by one character inserted, deleted or replaced.

    Returns `short_word short_n long_word long_n` once per pair; the first is the shorter, or the
    lesser of equally long words. Words must be distinct and not null.
    """
    if longest <= SHORTEST or 2 * longest - 2 > min_length:
        raise ValueError(f"grams of {longest} characters need words of at least {2 * longest - 2} characters")
    known = stored(words.select("word", "n").where(F.char_length("word") >= min_length).withColumn("id", F.monotonically_increasing_id()), "words")
    cut = known.select("id", "word").mapInArrow(_cutter(frequent_grams(known, longest, most), longest), _CUT)
    cut = stored(cut, "grams")
    sizes = cut.groupBy("gram").agg(F.count("*").alias("listed"))
    # The places of a gram stay in order under an edit, so both words agree on the order of shared grams.
    ranked = cut.join(sizes, "gram").groupBy("id", "chars", "grams", "affected").agg(F.sort_array(F.collect_list(F.struct("listed", "gram", "place"))).alias("by"))
    rarest = ranked.select("id", "chars", F.explode(F.slice("by", F.lit(1), F.least(F.col("affected") + 1, F.col("grams")))).alias("g"))
    lists = stored(rarest.select("id", "chars", "g.gram", "g.place").join(known, "id"), "lists")
    steps = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(p).alias("p")) for c, p in ((0, 0), (1, 0), (1, 1))])
    asking = lists.withColumn("step", F.explode(steps)).select(
        "gram",
        (F.col("chars") + F.col("step.c")).alias("chars"),
        (F.col("place") + F.col("step.p")).alias("place"),
        F.col("word").alias("short_word"),
        F.col("n").alias("short_n"),
    )
    answering = lists.select("gram", "chars", "place", F.col("word").alias("long_word"), F.col("n").alias("long_n"))
    met = asking.join(answering, ["gram", "chars", "place"])
    longer = F.char_length("long_word") > F.char_length("short_word")
    near = met.where((longer | (F.col("short_word") < F.col("long_word"))) & (F.levenshtein("short_word", "long_word", 1) == 1))
    return near.select("short_word", "short_n", "long_word", "long_n").distinct()


def variant_groups(words: DataFrame, pairs: DataFrame, ratio: int = 5) -> DataFrame:
    """`word form root n n_near form_n` for each row of `words`.

    A word's form is its near word of most occurrences (the least of equals) if that has `ratio`
    times as many as the word, else null. Forms are followed to the last; counts rise `ratio`-fold
    on every step, which bounds the doubling rounds.
    """
    both = pairs.select(F.col("short_word").alias("word"), F.col("long_word").alias("other"), F.col("long_n").alias("other_n")).unionByName(
        pairs.select(F.col("long_word").alias("word"), F.col("short_word").alias("other"), F.col("short_n").alias("other_n"))
    )
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.select("word", "n").join(near, "word", "left")
    takes = -F.col("best.less") >= ratio * F.col("n")
    rows = stored(
        rows.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(takes, F.col("best.other")).alias("form"),
            F.when(takes, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    follow = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    top, least = rows.agg(F.max("n"), F.min("n")).first()
    steps = math.floor(math.log(max(1, (top or 1) / (least or 1)), ratio)) + 1
    for _ in range(math.ceil(math.log2(steps))):
        ahead = follow.select(F.col("word").alias("at"), F.col("root").alias("on"))
        further = follow.join(ahead, F.col("root") == F.col("at"), "left")
        follow = stored(further.select("word", F.coalesce("on", "root").alias("root")), "roots")
    rooted = rows.join(follow, "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
