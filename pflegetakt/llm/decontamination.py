"""Benchmark decontamination with a distributed positional inverted index.

The index holds one posting (term, text key, position) per training token that the test items
use; it is split by document, every part in text order. A window of a test item is looked up
from its rarest terms: the postings of the rarest, moved back by the term's offset in the item,
give alignments (text, item, start); these are intersected with the offset-adjusted postings of a
second rare one, and what is left with those of all terms of the window. Exact matches need one
such pair of terms; proximity matches, which may lack words or have them off their places, need
one pair more for each word that may be missing. Everything is DataFrame expressions, joins and
aggregates.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, stored, unused

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ("k1", "k2")
BLOCK_BITS = 5


def _split(text: Column) -> Column:
    """Lower-cased (A-Z) words; a leading or trailing separator leaves an empty word at that end."""
    text = F.coalesce(text, F.lit(""))
    # lower() would change further letters; without any, it is the same and faster
    other = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.split(F.when(text.rlike(r"[^\x00-\x7F]"), other).otherwise(F.lower(text)), SEPARATORS)


def words_of(text: Column) -> Column:
    """All words of a text; none for null."""
    return F.filter(_split(text), lambda w: w != "")


def text_keys(text: Column) -> list[Column]:
    """96 hash bits that stand for a whole text, so that copies are looked up once."""
    return [F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")]


@dataclass(frozen=True)
class PhraseIndex:
    """Stored postings (term, k1, k2, pos), and how many each term has."""

    postings: DataFrame
    frequencies: DataFrame


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, length, offset, term) of every word of every test item; empty ones give none."""
    words = items.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("words"))
    return words.select("item", F.size("words").alias("length"), F.posexplode("words").alias("offset", "term"))


def build_index(docs: DataFrame, text_col: str, terms: DataFrame) -> PhraseIndex:
    """Stores the postings of the tokens that occur in `terms` (column term, may repeat).

    Null and empty texts have no postings. Repeated texts have repeated postings under one key.
    Documents are not shuffled.
    """
    vocabulary = small_side(stored(terms.select("term").distinct(), "vocabulary"))
    texts = docs.where(F.col(text_col).isNotNull())
    # keys first: beside the generator they would be computed for every token
    texts = texts.select(*text_keys(F.col(text_col)), _split(F.col(text_col)).alias("words"))
    tokens = texts.select(*KEY, F.posexplode("words").alias("pos", "term"))
    own = tokens.join(vocabulary, "term", "left_semi").select("term", *KEY, "pos")
    postings = stored(own, "postings")
    return PhraseIndex(postings, stored(postings.groupBy("term").agg(F.count("*").alias("n")), "frequencies"))


@dataclass(frozen=True)
class Near:
    """What a proximity match allows: words out of a hundred of a window that may be missing (rounded
    down to whole words), and how many words from its place a word may stand."""

    missing_percent: int = 20
    slack: int = 1


def _missing(size: Column, near: Near | None) -> Column:
    """Words of a window that may be missing."""
    return F.floor(size * F.lit(near.missing_percent if near else 0) / 100).cast("int")


def rarest_terms(index: PhraseIndex, terms: DataFrame, window: int, near: Near | None = None) -> DataFrame:
    """(item, offset, term, offset2, term2, low, high): pairs of rare terms that find the windows of the items.

    Each pair comes once, with the first offset of the windows it stands for and the one behind their
    last. An exact match has both of a window's two rarest terms. A match that may lack m words has
    both terms of one of m + 1 pairs without a common term; these are made of the rarest terms, the
    rarest of all with the least rare of them. Terms that the index lacks are missing anyway and
    leave fewer others to miss; windows that lack more than they may are left out. Ties of frequency
    go to the earlier offset. Windows of one word have it twice.
    """
    known = terms.join(index.frequencies, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    size = F.least(F.col("length"), F.lit(window))
    # every offset lies in the windows that start up to window - 1 words before it
    starts = F.sequence(F.greatest(F.col("offset") - size + 1, F.lit(0)), F.least(F.col("offset"), F.col("length") - size))
    spread = known.withColumn("start", F.explode(starts))
    ranked = spread.groupBy("item", "start").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("by"))
    there = ranked.select("item", "start", F.size("by").alias("size"), F.filter("by", lambda t: t["n"] > 0).alias("by"))
    spare = _missing(F.col("size"), near) - (F.col("size") - F.size("by"))
    there = there.withColumn("spare", spare).where((F.col("spare") >= 0) & (F.size("by") > 0))

    def pair(i: Column) -> Column:
        first = F.get("by", i)
        second = F.get("by", F.least(2 * F.col("spare") + 1 - i, F.size("by") - 1))
        return F.struct(
            first["offset"].alias("offset"), first["term"].alias("term"), second["offset"].alias("offset2"), second["term"].alias("term2")
        )

    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("spare")), pair))
    split = there.select("item", "start", "size", pairs.alias("p")).select("item", "start", "size", "p.*")
    # windows of one pair overlap, so what lies between the first and the last is less than two windows
    return split.groupBy("item", "offset", "term", "offset2", "term2").agg(
        F.min("start").alias("low"), F.max(F.col("start") + F.col("size")).alias("high")
    )


def _around(column: Column, slack: int) -> Column:
    return F.explode(F.sequence(column - slack, column + slack))


def _has(mask: str, position: Column) -> Column:
    """Whether a block's bit mask has this position."""
    bit = position.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    return F.call_function("shiftright", F.col(mask), bit).bitwiseAND(F.lit(1)) == 1


def _blocks(index: PhraseIndex, numbers: DataFrame, pairs: DataFrame, word: str) -> DataFrame:
    """(k1, k2, <word>, block, mask): the postings of the pairs' first or second words, a bit a position."""
    used = stored(numbers.join(pairs.select(F.col(word).alias("word")).distinct(), "word").select("term", F.col("word").alias(word)), "words")
    own = index.postings.join(small_side(used), "term").select(*KEY, word, "pos")
    bit = F.call_function("shiftleft", F.lit(1), F.col("pos").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)))
    return own.groupBy(*KEY, word, F.shiftright("pos", BLOCK_BITS).alias("block")).agg(F.bit_or(bit).alias("mask"))


def alignments(index: PhraseIndex, terms: DataFrame, window: int, near: Near | None = None) -> DataFrame:
    """(k1, k2, item, start, low, high): where item offsets from `low` to before `high` could lie in a text.

    `start` is the text position of the item's first word, which may lie outside the text.
    """
    reach = 2 * near.slack if near else 0  # both words may stand off their places, on opposite sides
    pairs = rarest_terms(index, terms, window, near)
    # terms of pairs go by a number from here on, which is shorter than the word in every shuffle
    words = pairs.select(F.explode(F.array("term", "term2")).alias("term")).distinct()
    numbers = stored(words.withColumn("word", F.monotonically_increasing_id()), "numbers")
    pairs = pairs.join(numbers.withColumnsRenamed({"word": "word1"}), "term")
    pairs = pairs.join(numbers.withColumnsRenamed({"term": "term2", "word": "word2"}), "term2")
    pairs = pairs.select("item", "offset", "word1", "offset2", "word2", "low", "high")
    rare = small_side(stored(pairs.withColumn("pair", F.monotonically_increasing_id()), "rarest"))
    apart = F.col("offset2") - F.col("offset")
    # every first word's positions meet the pairs once a text, however often the text repeats
    firsts = _blocks(index, numbers, rare, "word1").withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS) - 1))))
    firsts = firsts.where(_has("mask", F.col("bit"))).select(*KEY, "word1", (F.shiftleft("block", BLOCK_BITS) + F.col("bit")).alias("pos"))
    wanted = firsts.join(rare.select("pair", "word1", "word2", apart.alias("apart")), "word1")
    wanted = wanted.select(*KEY, "pair", "word2", (F.col("pos") + F.col("apart")).alias("at"))
    # where the second word may be lies in one block of positions or two
    first, last = F.shiftright(F.col("at") - reach, BLOCK_BITS), F.shiftright(F.col("at") + reach, BLOCK_BITS)
    wanted = wanted.withColumn("block", F.explode(F.sequence(first, last)) if reach else first)
    met = wanted.join(_blocks(index, numbers, rare, "word2"), [*KEY, "word2", "block"]).select(*KEY, "pair", "at", "block", "mask")
    met = met.withColumn("other", _around(F.col("at"), reach) if reach else F.col("at"))
    there = (F.shiftright("other", BLOCK_BITS) == F.col("block")) & _has("mask", F.col("other"))
    # the first word stands as far before `at` as its place before the second's, so the item starts here
    both = met.where(there).join(rare, "pair").withColumn("start", F.col("at") - F.col("offset2"))
    if reach:
        other = F.col("other") - F.col("offset2")
        starts = F.sequence(F.greatest("start", other) - near.slack, F.least("start", other) + near.slack)
        both = both.withColumn("start", F.explode(starts))
    return both.select(*KEY, "item", "start", "low", "high").distinct()


def aligned_terms(index: PhraseIndex, terms: DataFrame, window: int, near: Near | None = None) -> DataFrame:
    """(k1, k2, item, start, length, offset, pos): terms of candidate windows found in the text, each once.

    Only the windows that are candidates are unfolded, not their whole items. A term counts up to
    the slack from its place.
    """
    found = stored(alignments(index, terms, window, near), "alignments")
    places = found.select(*KEY, "item", "start", F.explode(F.sequence("low", F.col("high") - 1)).alias("offset")).distinct()
    expected = places.join(small_side(terms), ["item", "offset"]).withColumn("pos", F.col("start") + F.col("offset"))
    if near and near.slack:
        expected = expected.withColumn("pos", _around(F.col("pos"), near.slack))
    texts = small_side(stored(found.select(*KEY).distinct(), "texts"))
    there = index.postings.join(texts, list(KEY), "left_semi")
    return expected.join(there, [*KEY, "pos", "term"]).select(*KEY, "item", "start", "length", "offset", "pos").distinct()


def phrase_hits(aligned: DataFrame, window: int = 13) -> DataFrame:
    """(k1, k2, item, first, last): exact occurrences of runs of an item, `window` words or more.

    `aligned` is what `aligned_terms` found. Items of fewer words count as one window. `first` and
    `last` are word positions in the text.
    """
    found = aligned.where(F.col("pos") == F.col("start") + F.col("offset"))
    run = Window.partitionBy(*KEY, "item", "start").orderBy("offset")
    runs = found.withColumn("run", F.col("offset") - F.row_number().over(run))
    runs = runs.groupBy(*KEY, "item", "start", "run", "length").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return runs.where(F.col("last") - F.col("first") + 1 >= F.least(F.col("length"), F.lit(window))).select(*KEY, "item", "first", "last")


def proximity_hits(aligned: DataFrame, near: Near, window: int = 13) -> DataFrame:
    """(k1, k2, item, pos): words of texts in windows of an item of which enough words are near their places.

    `aligned` is what `aligned_terms` found with the same `near`. A window is a match at one start of
    the item in the text; it may reach over the ends of the text. Words that were put in place of
    missing ones do not count.
    """
    size = F.least(F.col("length"), F.lit(window))
    first, last = F.greatest(F.col("offset") - size + 1, F.lit(0)), F.least(F.col("offset"), F.col("length") - size)
    places = aligned.select(*KEY, "item", "start", "length", "offset").distinct()
    of_window = places.select(*KEY, "item", "start", size.alias("size"), F.explode(F.sequence(first, last)).alias("from"))
    counts = of_window.groupBy(*KEY, "item", "start", "from", "size").agg(F.count("*").alias("found"))
    good = counts.where(F.col("found") >= F.col("size") - _missing(F.col("size"), near))
    inside = good.select(*KEY, "item", "start", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("size") - 1)).alias("offset")).distinct()
    return aligned.join(inside, [*KEY, "item", "start", "offset"], "left_semi").select(*KEY, "item", "pos").distinct()


def _found_items(hits: DataFrame, ids: DataFrame) -> DataFrame:
    """(k1, k2, items, number): ids of the items found in each text; null is counted as one more."""
    found = hits.select(*KEY, "item").distinct().join(ids, "item")
    names = found.groupBy(*KEY).agg(F.array_sort(F.collect_set("id")).alias("items"), F.max(F.col("id").isNull().cast("long")).alias("unnamed"))
    return names.select(*KEY, "items", (F.size("items") + F.col("unnamed")).alias("number"))


def contamination(
    docs: DataFrame, text_col: str, items: DataFrame, item_col: str, item_text_col: str, window: int = 13, near: Near | None = None
) -> DataFrame:
    """(k1, k2, n_hit, items, n_items): per text key the words inside any found window, and the items found.

    With `near` also n_near and n_near_items: words that stand near their places in windows found by
    proximity, exact ones included, and the items of these windows. Only texts with a match are
    returned. Windows are found by an item's words, ids are joined to what is found: rows that share
    an id are texts of their own, and those without an id count for `n_hit`. Item ids are sorted as
    strings; `items` has those that are not null, `n_items` counts null as one more. Null and empty
    items and texts have no words and match nothing; repeated rows are one. Tables may be empty;
    further columns are not read.
    """
    words = items.select(F.col(item_col).cast("string").alias("id"), words_of(F.col(item_text_col)).alias("words"))
    words = words.where(F.size("words") > 0).withColumn("words", F.array_join("words", " "))
    named = stored(words.select(F.unhex(F.md5("words")).alias("item"), "id", "words").distinct(), "named")
    terms = stored(item_terms(named.select("item", "words").distinct(), "item", "words"), "items")
    aligned = aligned_terms(build_index(docs, text_col, terms), terms, window, near)
    aligned = stored(aligned, "aligned") if near else aligned
    hits = stored(phrase_hits(aligned, window), "hits")
    covered = hits.select(*KEY, F.explode(F.sequence("first", "last")).alias("pos")).distinct()
    n_hit = covered.groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    ids = small_side(stored(named.select("item", "id"), "ids"))
    exact = n_hit.join(_found_items(hits, ids).withColumnRenamed("number", "n_items"), list(KEY))
    if not near:
        return exact
    close = stored(proximity_hits(aligned, near, window), "near")
    n_near = close.groupBy(*KEY).agg(F.count_distinct("pos").alias("n_near"))
    close = n_near.join(_found_items(close, ids).select(*KEY, F.col("number").alias("n_near_items")), list(KEY))
    # every exact match is one by proximity
    return close.join(exact, list(KEY), "left")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one hit word, and a twentieth of all words hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _counted(text: Column) -> Column:
    """Number of words of a text."""
    words = _split(text)
    edges = (words[0] == "").cast("int") + ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")
    return (F.size(words) - edges).cast("long")


def without_contaminated(docs: DataFrame, text_col: str, found: DataFrame) -> DataFrame:
    """Leaves out the rows whose text is contaminated by what `found` has; all columns stay."""
    texts = docs.where(F.col(text_col).isNotNull()).select(*text_keys(F.col(text_col)), F.col(text_col).alias("text"))
    # only texts with a hit are split into words
    hit = texts.join(small_side(stored(found.select(*KEY, "n_hit"), "contamination")), list(KEY))
    bad = hit.where(contaminated(F.col("n_hit"), _counted(F.col("text")))).select(*KEY).distinct()
    k1, k2 = unused(docs, "_k1"), unused(docs, "_k2")
    rows = docs.withColumns({k1: F.xxhash64(text_col), k2: F.hash(text_col)})
    bad = stored(bad.toDF(k1, k2), "contaminated")
    return rows.join(small_side(bad), [k1, k2], "left_anti").drop(k1, k2)


def with_contamination(docs: DataFrame, text_col: str, found: DataFrame) -> DataFrame:
    """Adds n_words, contaminated and what `found` has (n_hit, items, n_items and, by proximity, n_near,
    n_near_items) to every row of `docs`; columns of those names are replaced.

    Null and empty texts have no words and are not contaminated; repeated rows get equal answers.
    """
    k1, k2 = unused(docs, "_k1"), unused(docs, "_k2")
    counts = [name for name in found.columns if name not in (*KEY, "items")]
    rows = docs.drop("n_words", "contaminated", "items", *counts)
    rows = rows.withColumns({"n_words": _counted(F.col(text_col)), k1: F.xxhash64(text_col), k2: F.hash(text_col)})
    result = found.withColumnsRenamed({"k1": k1, "k2": k2})
    joined = rows.join(small_side(stored(result, "contamination")), [k1, k2], "left").drop(k1, k2)
    joined = joined.withColumns({name: F.coalesce(name, F.lit(0)).cast("long") for name in counts})
    return joined.withColumns(
        {
            "items": F.coalesce("items", F.array().cast("array<string>")),
            "contaminated": contaminated(F.col("n_hit"), F.col("n_words")),
        }
    )
