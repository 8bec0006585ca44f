"""Helpers shared by the corpus operators: shared storage, size checks, hold-out rule."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
"""A side is broadcast only after a count found at most this many (narrow) rows."""


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session gets a temporary folder; a cluster is refused, because
    its machines could not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    root = tempfile.mkdtemp(prefix="shared-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new name below the shared folder, deleted when the driver ends."""
    path = f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"
    jvm = spark._jvm.org.apache.hadoop.fs
    target = jvm.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, kind: str = "table") -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends, nothing is cached."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a stored, narrow table for broadcast if a count proves it small; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unused(df: DataFrame, name: str) -> str:
    """The name, behind as many underscores as no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sent_once(spark: SparkSession, model: Any) -> Callable[[], Any]:
    """Broadcasts a model of bounded size; a task calls the result once to get it.

    The class of the model is sent with it, because executors need not have this package.
    """
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(shared.value)  # noqa: S301


class Once:
    """A table made at the first call in each task; only the recipe is sent to tasks, not the table."""

    def __init__(self, make: Callable[[], Any]):
        self.make, self.value = make, None

    def __call__(self) -> Any:
        if self.value is None:
            self.value = self.make()
        return self.value

    def __reduce__(self):
        return Once, (self.make,)


def held_out(doc_id: Column) -> Column:
    """The rows no model may learn from: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """About `rows` rows (all, if there are no more), chosen by a hash of the named columns.

    The choice depends on the values alone, not on files, partitions or retries. The bound is
    one in expectation; rows equal in the named columns come together.
    """
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*by), F.lit(1 << 30)) < int(rows / total * (1 << 30)))
