"""Delimited files with line breaks inside quotes, read by many tasks.

Whether a line break ends a record depends on all quotes before it. Their count is a prefix sum: quotes
are counted by block of the file, blocks are summed up (one row a block), and the sum before a block
says whether it begins inside quotes. Each task then puts the records of its blocks together while it
reads them, holding no more than one batch of lines and one record; only records cut by the border of
a block are gathered from their parts, at most two parts a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_LINES = 10_000
"""Lines a record may have; more mean that a quote is never closed."""

PARTS = "path string, block bigint, row bigint, record string, n bigint, starts boolean, ends boolean"


def _odd(count: Column) -> Column:
    return count.bitwiseAND(F.lit(1)) == 1


def numbered_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(path, block, place, line): lines by block; places count the lines of a task as it reads them."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.decode(F.col("value").cast("binary"), encoding).alias("line"),
    )


def block_states(lines: DataFrame) -> DataFrame:
    """(path, block, inside): whether a block begins inside quotes. One row a block."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    blocks = lines.groupBy("path", "block").agg(F.sum(quotes).alias("quotes"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(
        "path", "block", _odd(F.coalesce(F.sum("quotes").over(earlier), F.lit(0))).alias("inside")
    )


def _parts(most_lines: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines (path, block, place, line, inside) of a task to the parts that records have in its blocks.

    The result is sent to tasks by value and needs none of this package there.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # lines of the block's open part, the number of its first line, and whether that begins inside quotes
        held, row, inside = pa.array([], pa.string()), 1, False
        here, place = None, None

        def parts(lines: pa.Array, cuts: np.ndarray, ends: bool) -> pa.RecordBatch:
            """The parts between the cuts; the first may begin inside quotes, the last may not end the record."""
            n, count = np.diff(cuts), len(cuts) - 1
            if n.max() > most_lines:
                raise ValueError(f"a quote is not closed in {here[0]}")
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), lines), "\n")
            starts, ended = np.ones(count, bool), np.ones(count, bool)
            starts[0], ended[-1] = not inside, ends
            columns = [pa.repeat(here[0], count), pa.array(np.full(count, here[1])), pa.array(row + cuts[:-1]), texts]
            columns += [pa.array(n), pa.array(starts), pa.array(ended)]
            return pa.RecordBatch.from_arrays(columns, ["path", "block", "row", "record", "n", "starts", "ends"])

        def rest() -> pa.RecordBatch:
            quotes = int(inside) + (pc.sum(pc.count_substring(held, '"')).as_py() or 0)
            return parts(held, np.asarray([0, len(held)]), quotes % 2 == 0)

        for batch in batches:
            if not batch.num_rows:
                continue
            paths, blocks, places, text, states = batch.columns
            numbers = places.to_numpy()
            if (np.diff(numbers, prepend=numbers[0] - 1 if place is None else place) != 1).any():
                raise ValueError("the lines of a task did not come in their order")
            place = numbers[-1]
            other = pc.or_(pc.not_equal(paths[1:], paths[:-1]), pc.not_equal(blocks[1:], blocks[:-1]))
            borders = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(borders, borders[1:], strict=False):
                block = (paths[begin].as_py(), blocks[begin].as_py())
                if block != here:
                    if here is not None:
                        yield rest()
                    here, held, row, inside = block, held[:0], 1, states[begin].as_py()
                lines = pa.concat_arrays([held, text[begin:end]])
                quotes = pc.count_substring(lines, '"').to_numpy().astype(np.int64)
                before = (np.cumsum(quotes) - quotes + int(inside)) % 2 == 1
                cuts = np.union1d([0], np.flatnonzero(~before))
                if len(lines) - cuts[-1] > most_lines:
                    raise ValueError(f"a quote is not closed in {here[0]}")
                if len(cuts) > 1:
                    yield parts(lines[: cuts[-1]], cuts, True)
                held, row, inside = lines[cuts[-1] :], row + int(cuts[-1]), bool(before[cuts[-1]])
        if here is not None:
            yield rest()

    return work


def quoted_records(spark: SparkSession, path: str, encoding: str = "UTF-8", most_lines: int = MOST_LINES) -> DataFrame:
    """(path, block, row, record): the records of files in which quoted values may hold line breaks.

    ``path``, ``block`` and ``row`` are the place of the record's first line and rise along the file. A
    file is split however Spark splits it. A quote inside a value must be doubled; outside of quotes
    there are none. Empty lines outside of quotes are no records, and a carriage return at the end of
    a record belongs to the line break. A record of more than ``most_lines`` lines fails the run.
    """
    lines = numbered_lines(spark, path, encoding)
    # where a block begins does not depend on how the rest of the file was split, so each state found is right
    states = F.broadcast(block_states(lines).withColumn("known", F.lit(True)))  # keeps the lines in their order
    inside = F.when(F.col("known"), F.col("inside")).otherwise(
        F.raise_error(F.concat(F.lit("the splits of a file changed while it was read: "), "path")).cast("boolean")
    )
    met = lines.join(states, ["path", "block"], "left").select("path", "block", "place", "line", inside.alias("inside"))
    parts = met.mapInArrow(_parts(most_lines), PARTS)
    whole = F.col("starts") & F.col("ends")
    alone = parts.filter(whole).select("path", "block", "row", "record")
    along = Window.partitionBy("path").orderBy("block", "row")
    began = F.last(F.when(F.col("starts"), F.struct("block", "row")), ignorenulls=True).over(along)
    cut = parts.filter(~whole).withColumn("first", began)
    # told before anything is gathered
    so_far = F.sum("n").over(Window.partitionBy("path", "first").orderBy("block", "row"))
    endless = F.raise_error(F.concat(F.lit("a quote is not closed in "), "path")).cast("string")
    counted = cut.withColumn("so_far", so_far)
    counted = counted.withColumn("record", F.when(F.col("so_far") > most_lines, endless).otherwise(F.col("record")))
    pieces = F.array_sort(F.collect_list(F.struct("block", "row", "record")))
    gathered = counted.groupBy("path", "first").agg(pieces.alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: p["record"]), "\n")
    joined = gathered.select("path", "first.block", "first.row", text.alias("record"))
    records = alone.unionByName(joined).withColumn("record", F.regexp_replace("record", r"\r$", ""))
    return records.filter(F.col("record") != "")
