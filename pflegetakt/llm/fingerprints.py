"""Document fingerprints: SimHash over weighted term hashes, in Spark expressions only.

Every term of a text (a word, lower-cased) votes with its 64-bit hash on 64 signed bits; its
weight is its length, so that the short words all texts share count little. Votes are summed
two bits to a number, which keeps the aggregation at 33 sums.

Near fingerprints are found with permuted block tables: two fingerprints that differ in at most
r bits agree in at least b - r of b blocks, so a table for each choice of b - r blocks, keyed by
these blocks' bits, has every near pair in one of its buckets.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SPACE = r"[\x20\x09-\x0D]+"
_LANES = 0x0000000100000001
_LOW = 0xFFFFFFFF


def term_votes(term: Column) -> list[Column]:
    """32 sums of two bits each, and the sum of weights, over the terms of a group."""
    h, weight = F.xxhash64(F.lower(term)), F.char_length(term).cast("long")
    lanes = [F.sum(weight * F.shiftright(h, i).bitwiseAND(F.lit(_LANES))).alias(f"v{i}") for i in range(32)]
    return [*lanes, F.sum(weight).alias("total")]


def fingerprint_of_votes() -> Column:
    """64 bits (a long): a bit is set if more than half of the weight votes for it."""
    out = F.lit(0).cast("long")
    for i in range(32):
        lane = F.col(f"v{i}")
        low, high = lane.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(lane, 32)
        for bit, votes in ((i, low), (i + 32, high)):
            mask = 1 << bit
            out = out.bitwiseOR(F.when(2 * votes > F.col("total"), F.lit(mask - (1 << 64) if mask >> 63 else mask)).otherwise(F.lit(0)))
    return out


def fingerprints(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, fingerprint): the SimHash of every distinct key's text.

    Rows of one key must have equal texts; they come back as one. Null and empty texts, and
    texts of blanks, have fingerprint 0. Key columns may be null; further columns are not read.
    """
    terms = df.select(*keys, F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), SPACE)).alias("term"))
    return terms.groupBy(*keys).agg(*term_votes(F.col("term"))).select(*keys, fingerprint_of_votes().alias("fingerprint"))


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def followers(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, next_<key>...): the row that follows each distinct row in ascending order, nulls first.

    After the last row comes the first. The order is dealt by range, numbered by partition and
    stored, so no task sees all rows; the first rows of the parts, one a partition, are joined up.
    """
    dealt = df.select(*keys).distinct().repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    parts = stored(dealt, "order")
    within = Window.partitionBy("_part").orderBy(*keys)
    row = F.struct(*keys)
    chained = parts.withColumns({"_next": F.lead(row).over(within)})
    heads = parts.groupBy("_part").agg(F.min(row).alias("_head"))
    ahead = Window.orderBy("_part")  # one row a partition
    around = heads.select("_part", F.coalesce(F.lead("_head").over(ahead), F.first("_head").over(ahead)).alias("_wrap"))
    linked = chained.join(F.broadcast(around), "_part")
    step = F.coalesce("_next", "_wrap")
    return linked.select(*keys, *(step[k].alias(f"next_{k}") for k in keys))


def block_tables(blocks: int, radius: int) -> list[tuple[int, int]]:
    """(table number, mask of its bits): one table for every choice of blocks - radius blocks."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("needs fewer differing bits than blocks")
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) & ~((1 << edges[i]) - 1) for i in range(blocks)]
    chosen = [sum(c) for c in combinations(masks, blocks - radius)]
    return [(i, m - (1 << 64) if m >> 63 else m) for i, m in enumerate(chosen)]


def near_fingerprints(queries: DataFrame, table: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(query, fingerprint): all distinct fingerprints of `table` within `radius` bits of each query.

    Both sides have one column `fingerprint`; repeated ones are one. A pair that shares several
    buckets is returned from the first of its tables only, so pairs need no shuffle to be
    distinct. Null fingerprints match nothing.
    """
    masks = block_tables(blocks, radius)
    entry = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.lit(m).alias("m")) for i, m in masks)))

    def dealt(df: DataFrame, name: str) -> DataFrame:
        own = df.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct().select(name, entry.alias("e"))
        return own.select(name, "e.t", F.col(name).bitwiseAND(F.col("e.m")).alias("bucket"))

    pairs = dealt(queries, "query").join(dealt(table, "fingerprint"), ["t", "bucket"])
    apart = F.col("query").bitwiseXOR(F.col("fingerprint"))
    first = F.coalesce(*(F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in masks))
    return pairs.where((F.bit_count(apart) <= radius) & (first == F.col("t"))).select("query", "fingerprint")
