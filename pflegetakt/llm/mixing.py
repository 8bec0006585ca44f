"""Mixing to target weights with soft membership.

A classifier learned from a labelled table gives every document a posterior over domains. Then
nonnegative rates r are fitted, one a document, so that the expected tokens of each domain,
sum(r * tokens * posterior), match the targets: least squares by projected gradient. Only one
number a domain travels per step; rates follow from the steps' short history wherever needed.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import bounded_sample, sent_once, stored

BUCKETS = 2048
SHAPES = 8


LATIN = [chr(i) for i in range(256)]
LOWERED = bytes(ord(c.lower()) for c in LATIN)
NO_LETTERS = bytes(i for i, c in enumerate(LATIN) if not c.isalpha() and c != "\n")


def _letters(lines: str) -> bytes:
    """The lower-cased letters of every line, in UTF-8; lines stay lines."""
    try:
        return lines.encode("latin-1").translate(LOWERED, NO_LETTERS).decode("latin-1").encode()
    except UnicodeEncodeError:
        cores = (w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in lines.split("\n"))
        return "\n".join(cores).lower().encode()


def text_features(text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    """(tokens, feature numbers, values): hashed words, log-scaled to unit length, and shapes.

    Shapes: an always-on one, shares of upper-case, of decorated and of cut-off words, and of
    repeated ones. Null and empty texts have only the always-on feature. All different words of a
    text are cleaned at once: no table of words grows with the corpus.
    """
    words = text.split() if text else []
    counts = Counter(words)
    times = np.fromiter(counts.values(), np.float64, len(counts))
    cores = _letters("\n".join(counts)).split(b"\n") if counts else []
    bucket = np.fromiter(map(zlib.crc32, cores), np.int64, len(counts)) % BUCKETS
    total = np.bincount(bucket, times, BUCKETS)
    index = np.flatnonzero(total)
    value = np.log1p(total[index])
    value /= np.sqrt((value**2).sum()) + 1e-9
    n = max(len(words), 1)
    odd = [w for w in counts if not w.isalpha()]
    unended = [w for w in odd if not w[-1].isalnum()]
    shapes = np.asarray(
        [
            1.0,
            float(times @ np.fromiter(map(str.isupper, counts), np.float64, len(counts))) / n,
            sum(counts[w] for w in unended if w[-1] not in ".,;:") / n,
            sum(counts[w] for w in unended if not any(map(str.isalnum, w))) / n,
            1 - len(counts) / n,
            sum(counts[w] for w in odd if w[0].isdigit()) / n,
            min(np.log1p(len(words)) / 10, 2.0),
            0.0,
        ]
    )
    return len(words), np.concatenate([index, BUCKETS + np.arange(SHAPES)]), np.concatenate([value, shapes])


@dataclass(frozen=True)
class DomainModel:
    """Softmax weights (features x domains)."""

    domains: tuple[str, ...]
    weights: np.ndarray


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_domains(labelled: DataFrame, text_col: str, domain_col: str, id_col: str, sample: int = 6000, rounds: int = 300) -> DomainModel:
    """Softmax regression on about `sample` labelled rows (a documented bound, chosen by hash).

    Rows without a domain are left out; without any there is one domain, "all".
    """
    own = labelled.where(F.col(domain_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("domain"), F.col(text_col).alias("text")
    )
    own = bounded_sample(own, sample, "id", "text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_features(t.as_py()) for t in batch.column(1)]
            arrays = [batch.column(0), pa.array([i for _, i, _ in found], pa.list_(pa.int64())), pa.array([v for _, _, v in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["domain", "at", "value"])

    rows = own.select("domain", "text").mapInArrow(emit, "domain string, at array<long>, value array<double>").collect()
    domains = tuple(sorted({r["domain"] for r in rows})) or ("all",)
    x = np.zeros((len(rows), BUCKETS + SHAPES), np.float32)
    y = np.zeros((len(rows), len(domains)), np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["value"]
        y[i, domains.index(r["domain"])] = 1
    w = np.zeros((BUCKETS + SHAPES, len(domains)), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1 if len(rows) else 1):
        g = x.T @ (_softmax(x @ w) - y) / len(rows) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return DomainModel(domains, w)


def _posteriors(weights: np.ndarray, text: str | None) -> tuple[int, np.ndarray]:
    n, at, value = text_features(text)
    return n, _softmax(value @ weights[at])


def predict_domains(df: DataFrame, model: DomainModel, keep: list[str], text_col: str) -> DataFrame:
    """(kept columns, n_tokens, posteriors): of every whole text; null and empty texts have no tokens."""
    shared = sent_once(df.sparkSession, model)  # features x domains
    own = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    kept = [f for f in own.schema.fields if f.name != "_text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared().weights.astype(np.float64)
        for batch in batches:
            tokens, posteriors = [], []
            for text in batch.column(batch.num_columns - 1):
                n, posterior = _posteriors(weights, text.as_py())
                tokens.append(n)
                posteriors.append(posterior)
            arrays = [*batch.columns[:-1], pa.array(tokens, pa.int64()), pa.array(posteriors, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "n_tokens", "posteriors"])

    schema = StructType([*kept, StructField("n_tokens", LongType()), StructField("posteriors", ArrayType(DoubleType()))])
    return own.mapInArrow(work, schema)


@dataclass(frozen=True)
class Mix:
    """Targets, and the steps from which every document's rate follows."""

    domains: tuple[str, ...]
    natural: np.ndarray
    targets: np.ndarray
    reached: np.ndarray
    steps: np.ndarray
    least_rate: float

    @property
    def residual(self) -> float:
        """Largest distance of a domain from its target, as a share of the target."""
        return float(np.max(np.abs(self.reached - self.targets) / np.maximum(self.targets, 1e-300), initial=0, where=self.targets > 0))

    def rates(self, posteriors: np.ndarray) -> np.ndarray:
        """Rates of documents with these posteriors: the projected steps, one after the other."""
        r = np.ones(len(posteriors))
        for step in self.steps:
            r = np.maximum(r - posteriors @ step, self.least_rate)
        return r


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _expected(scored: DataFrame, mix: Mix) -> np.ndarray:
    """Expected tokens of each domain under the present rates: one sum a domain."""
    n = len(mix.domains)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for batch in batches:
            p = _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, n))
            total += (mix.rates(p) * batch.column(0).to_numpy()) @ p
        yield pa.RecordBatch.from_arrays([pa.array(total[i : i + 1]) for i in range(n)], [f"d{i}" for i in range(n)])

    parts = scored.select("n_tokens", "posteriors").mapInArrow(part, ", ".join(f"d{i} double" for i in range(n)))
    row = parts.agg(*(F.sum(f"d{i}") for i in range(n))).first()
    return np.asarray([x or 0.0 for x in row])


def tempered(natural: np.ndarray, power: float) -> np.ndarray:
    """Weights between the natural shares (power 1) and equal ones (power 0)."""
    share = np.where(natural > 0, np.power(np.maximum(natural, 1e-300) / max(natural.sum(), 1e-300), power), 0)
    return share / max(share.sum(), 1e-300)


def fit_mix(
    scored: DataFrame,
    domains: tuple[str, ...],
    weights: dict[str, float] | None = None,
    power: float = 0.7,
    tokens: float | None = None,
    keep_all: bool = False,
    tolerance: float = 1e-3,
    rounds: int = 30,
) -> Mix:
    """Fits rates >= 0 whose expected domain tokens match `weights` x `tokens`.

    `scored` (n_tokens, posteriors) should be stored. Without `weights` the natural shares are
    tempered by `power`; without `tokens` the corpus keeps its size, or with `keep_all` takes the
    least size at which no domain shrinks, and rates stay at 1 or more. Each residual is divided
    by its domain's natural tokens and each document's step by its tokens; the step matrix then
    is row-stochastic, so a step of 1 converges and needs no tuning. Ends when every domain is
    within `tolerance` of its target, or after `rounds` steps as near as they came: the `residual` of
    the fit says how near. Domains without tokens have target 0.
    """
    n = len(domains)
    mix = Mix(domains, np.zeros(n), np.zeros(n), np.zeros(n), np.zeros((0, n)), 1.0 if keep_all else 0.0)
    natural = _expected(scored, mix)
    share = np.asarray([weights.get(d, 0.0) for d in domains]) if weights else tempered(natural, power)
    share = np.where(natural > 0, share, 0)
    share = share / max(share.sum(), 1e-300)
    if tokens is None:
        tokens = float(max((x / s for x, s in zip(natural, share, strict=True) if s > 0), default=0)) if keep_all else natural.sum()
    targets = share * tokens
    if keep_all:
        targets = np.maximum(targets, natural)
    reached, steps = natural, []
    for _ in range(rounds):
        step = np.where(natural > 0, (reached - targets) / np.maximum(natural, 1e-300), 0)
        if (np.abs(reached - targets) <= tolerance * np.maximum(targets, tolerance * max(targets.sum(), 1e-300))).all():
            break
        steps.append(step)
        mix = Mix(domains, natural, targets, reached, np.asarray(steps), mix.least_rate)
        reached = _expected(scored, mix)
    return Mix(domains, natural, targets, reached, np.asarray(steps).reshape(-1, n), mix.least_rate)


def _copies(rate: Column, seed_cols: list[str]) -> Column:
    """The rate rounded up or down by a hash, so that its expectation is the rate."""
    chance = F.pmod(F.xxhash64(F.lit("copies"), *seed_cols), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")


def repeat_by_rate(df: DataFrame, model: DomainModel, mix: Mix, id_col: str, text_col: str) -> DataFrame:
    """Every row of `df` as often as the fit says, with the columns of `df` whatever their names.

    The rows are scored once more, and each carries its own rate: model and steps are small, so no
    text is joined or shuffled at any size.
    """
    shared, plan = sent_once(df.sparkSession, model), mix
    own = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("text_key"),
        F.col(text_col).cast("string").alias("text"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared().weights.astype(np.float64)
        for batch in batches:
            found = [_posteriors(weights, text.as_py())[1] for text in batch.column("text")]
            rates = plan.rates(np.asarray(found, np.float64).reshape(len(found), len(plan.domains)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rates)], [*batch.schema.names[:-1], "rate"])

    rated = own.mapInArrow(work, StructType([*own.schema.fields[:-1], StructField("rate", DoubleType())]))
    times = F.sequence(F.lit(1), _copies(F.col("rate"), ["id", "text_key"]).cast("int"))
    some = rated.where(_copies(F.col("rate"), ["id", "text_key"]) > 0)
    return some.select("row", F.explode(times)).select("row.*")


def with_rates(scored: DataFrame, mix: Mix, keep: list[str], seed_cols: list[str]) -> DataFrame:
    """(kept, n_tokens, posteriors, rate, copies): copies is rate rounded up or down by a hash of the seed columns.

    The expectation of copies over seeds is the rate; repeated rows get equal ones.
    """
    kept = [scored.schema[k] for k in [*keep, *(c for c in seed_cols if c not in keep)]]
    names = [f.name for f in kept]
    own = scored.select(*names, "n_tokens", "posteriors")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _matrix(batch.column(batch.num_columns - 1)) if batch.num_rows else np.zeros((0, len(mix.domains)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mix.rates(p))], [*batch.schema.names, "rate"])

    rated = own.mapInArrow(work, StructType([*own.schema.fields, StructField("rate", DoubleType())]))
    return rated.withColumn("copies", _copies(F.col("rate"), seed_cols)).select(*keep, "n_tokens", "posteriors", "rate", "copies")


def mix_documents(
    df: DataFrame, model: DomainModel, id_col: str, text_col: str, **options
) -> tuple[DataFrame, Mix]:
    """(id, text_key, n_tokens, posteriors, rate, copies) of every row, and the fit.

    Null and empty texts have no tokens; their rates follow from their posteriors like others'.
    Repeated rows get equal rates; an empty table gives an empty one; further columns are not read.
    """
    own = df.select(id_col, text_col, F.xxhash64(text_col).alias("text_key"))
    scored = stored(predict_domains(own, model, [id_col, "text_key"], text_col), "posteriors")
    mix = fit_mix(scored, model.domains, **options)
    return with_rates(scored, mix, [id_col, "text_key"], [id_col, "text_key"]), mix
