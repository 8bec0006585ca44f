"""Registered queries with trained models: mixing and toxicity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, pii, toxicity
from .common import bounded_sample, held_out, table

ORACLE: dict[str, str] = {}

TOXIC_FROM = 0.3
MIX_POWER = 0.7
LABELLED = 6000


def domain_model(spark: SparkSession, sf_dir: str) -> mixing.DomainModel:
    """Domains language/quality, learned from a bounded sample of labelled documents."""
    labels = table(spark, sf_dir, "labels").where("doc_id is not null and quality is not null")
    labels = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labels = F.broadcast(bounded_sample(labels, LABELLED, "doc_id"))  # bounded by LABELLED
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(labels, "doc_id")
    return mixing.fit_domains(rows.withColumn("domain", F.concat_ws("/", "lang", "quality")), "text", "domain", "doc_id", LABELLED)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents under which the domains' expected tokens match tempered weights."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, _ = mixing.mix_documents(docs, domain_model(spark, sf_dir), "doc_id", "text", power=MIX_POWER)
    return rows.select("doc_id", "n_tokens", "posteriors", "rate", "copies")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document: the patterns' spans and the network's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tagger = pii.fit_tagger(docs, "doc_id", "text")
    return pii.find_personal_data(docs, tagger, ["doc_id"], "text")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    """Learned from labels of rows that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return toxicity.fit_toxicity(table(spark, sf_dir, "documents"), labels)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = toxicity.score_toxicity(docs, toxicity_model(spark, sf_dir), ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mixing, op4_pii, op8_toxicity)}
