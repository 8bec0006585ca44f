"""Sharding by jump consistent hashing (Lamping and Veach), in Spark expressions only.

A key's shard follows from the key and the number of shards alone; there is no ring or table.
Going from n to n + 1 shards moves about one key in n + 1, and only into the new shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the published generator: multiplier and modulus.
_MULTIPLIER = "2862933555777941757"
_MODULUS = "18446744073709551616"

KEY_BLOCKS = 1024
TEXT_BLOCKS = 16


def key_bits(*keys: Column) -> Column:
    """64 bits of the key columns as an unsigned number (decimal(20, 0)); null is a key too."""
    signed = F.xxhash64(*keys).cast("decimal(20,0)")
    return F.when(signed < 0, signed + F.expr(f"{_MODULUS}BD")).otherwise(signed).cast("decimal(20,0)")


def jump_hash(bits: Column, shards: int) -> Column:
    """Shard 0 to shards - 1 of 64 unsigned bits.

    The fold makes at most shards - 1 jumps, as each goes at least one shard further; products
    are exact decimals of at most 38 digits, reduced to 64 bits.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def step(state: Column, _: Column) -> Column:
        key = (state["key"] * F.expr(f"{_MULTIPLIER}BD") + F.expr("1BD")) % F.expr(f"{_MODULUS}BD")
        key = key.cast("decimal(20,0)")
        high = ((key - key % F.expr("8589934592BD")) / F.expr("8589934592BD")).cast("double")
        ahead = F.floor((state["next"] + 1) * (F.lit(2147483648.0) / (high + 1.0)))
        jump = F.struct(key.alias("key"), state["next"].alias("shard"), ahead.alias("next"))
        return F.when(state["next"] < shards, jump).otherwise(state)

    start = F.struct(
        bits.cast("decimal(20,0)").alias("key"),
        F.lit(-1).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("next"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["shard"]).cast("int")


def assign_shards(
    df: DataFrame, keys: Sequence[str], shards: int, shard_col: str = "shard", grown_col: str | None = None
) -> DataFrame:
    """Adds the shard of every row, without a shuffle.

    `grown_col` names a second column with the shard under one more shard. Null keys are keys
    like others and share a shard; repeated rows get equal shards; a column of the name of an
    added one is replaced; an empty table stays empty. Other columns are not looked at.
    """
    bits = key_bits(*(F.col(k) for k in keys))
    out = {shard_col: jump_hash(bits, shards)}
    if grown_col:
        out[grown_col] = jump_hash(bits, shards + 1)
    return df.withColumns(out)


def number_within_shards(df: DataFrame, keys: Sequence[str], spread: str, shard_col: str, slot_col: str) -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps, without a task that sees a whole shard.

    Every shard is cut by key hash into 1024 blocks and each by the top bits of `spread` (an
    unsigned 32-bit number) into 16; rows are numbered per block, and the blocks' counts, at
    most 16,384 a shard whatever the input, are summed up before. Rows equal in all columns are
    counted first and numbered together, so repeated rows meet as one.
    """
    names = df.columns
    block = F.pmod(F.xxhash64(*(F.col(k) for k in keys)), F.lit(KEY_BLOCKS)) * TEXT_BLOCKS
    block = block + F.coalesce(F.shiftright(F.col(spread), 28), F.lit(0))
    rows = df.groupBy(*names).agg(F.count("*").alias("_copies")).withColumn("_block", block)
    order = [F.col(c) for c in (*keys, *(n for n in names if n not in keys))]
    w = Window.partitionBy(shard_col, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum("_copies").over(w), F.lit(0)))
    totals = rows.groupBy(shard_col, "_block").agg(F.sum("_copies").alias("_n"))
    up_to = Window.partitionBy(shard_col).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(shard_col, "_block", F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_base"))
    first = F.col("_base") + F.col("_before")
    slots = F.sequence(first, first + F.col("_copies") - 1)
    return placed.join(base, [shard_col, "_block"]).select(*names, F.explode(slots).alias(slot_col))
