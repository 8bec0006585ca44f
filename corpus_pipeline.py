"""The corpus pipeline: toxic documents out, one of each group of near-duplicates, contaminated
documents out, mixed to target weights, dealt into shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pflegetakt.llm import decontamination, mixing, near_duplicates, sharding, toxicity
from pflegetakt.llm.common import new_folder, table, unused
from pflegetakt.llm.queries_copies import BITS, SHINGLE, WINDOW
from pflegetakt.llm.queries_models import MIX_POWER, TOXIC_FROM, domain_model, toxicity_model

SHARDS = 16

ORACLE_SQL = None
"""Two stages are trained models and one is an iterative fit; the tests compare them with brute force."""


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the limit. Null and empty texts stay."""
    names, score = docs.columns, unused(docs, "_toxicity")
    scored = toxicity.score_toxicity(docs, toxicity_model(spark, sf_dir), names, "text", score)
    return scored.where(F.col(score) < TOXIC_FROM).select(*names)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each component of near fingerprints."""
    return near_duplicates.keep_one_each(docs, "doc_id", "text", SHINGLE, BITS)


def without_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth, or none, lie in benchmark windows."""
    names = docs.columns
    found = decontamination.contamination(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text", WINDOW)
    return decontamination.without_contaminated(docs, "text", found).select(*names)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its rate says: at least once, more in domains to be raised.

    Rates are fitted so that no domain shrinks; each is realised by whole copies, its fraction by
    a hash of the document.
    """
    model = domain_model(spark, sf_dir)
    _, mix = mixing.mix_documents(docs, model, "doc_id", "text", power=MIX_POWER, keep_all=True)
    return mixing.repeat_by_rate(docs, model, mix, "doc_id", "text")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard, and the shard they would have with one more."""
    return sharding.assign_shards(docs, ["doc_id"], SHARDS, "shard", "grown_shard")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_contaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_folder(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
