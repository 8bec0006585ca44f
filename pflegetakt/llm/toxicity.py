"""Toxicity by weak supervision.

Many voters, each a lexicon word or a word-prefix pattern, vote on a text by occurring in it
often enough for its length; further voters look at the share of all lexicon words. The given
labels choose the voters: words and patterns of texts labelled toxic that are far likelier there
than in others. A generative label model estimates how often each voter fires on toxic and on
other texts; its EM starts from the labels, which also are one of its voters, and may depart from
them. After EM, dependence of voters is measured among toxic texts only. Its posteriors then train
a linear classifier on all sharp words, patterns and shares, which scores every text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bounded_sample, sent_once, stored

PREFIXES = (4, 5, 6, 7, 8)
PER_WORDS = 200
"""A word or pattern counts if it occurs once per that many words of the text, or more often."""
SHARES = (0.004, 0.008, 0.016)
"""Shares of lexicon words in a text that are features of their own."""
_WORD = re.compile(r"[^\W\d_]+")


def _features(word: str) -> list[str]:
    """The word, and its prefix patterns (marked by a star)."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def _words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _signature(words: list[str]) -> int:
    """Least hash of the text's runs of three words: near copies mostly share it."""
    runs = zip(words, words[1:], words[2:], strict=False)
    return min((zlib.crc32(" ".join(r).encode()) for r in runs), default=zlib.crc32(" ".join(words).encode()))


class Matcher:
    """Numbers of the features a text's words have; words are looked up once.

    Behind the named features come the shares of words that have any of them.
    """

    def __init__(self, features: list[str], shares: tuple[float, ...] = ()):
        self.index = {f: i for i, f in enumerate(features)}
        self.shares = shares
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, words: list[str]) -> list[int]:
        total: dict[int, int] = {}
        lexicon = 0
        if len(self.known) > 500_000:
            self.known.clear()
        for word, n in Counter(words).items():
            own = self.known.get(word)
            if own is None:
                own = self.known[word] = tuple(self.index[f] for f in _features(word) if f in self.index)
            if own:
                lexicon += n
                for f in own:
                    total[f] = total.get(f, 0) + n
        found = sorted(f for f, n in total.items() if n * PER_WORDS >= len(words))
        return found + [len(self.index) + k for k, s in enumerate(self.shares) if lexicon and lexicon >= s * len(words)]


@dataclass(frozen=True)
class LabelModel:
    """Rates at which voters fire on toxic and other texts, and their shares of independent evidence."""

    prior: float
    fires_toxic: np.ndarray
    fires_other: np.ndarray
    share: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of toxic for rows of 0/1 votes."""
        on = np.log(self.fires_toxic / self.fires_other)
        off = np.log((1 - self.fires_toxic) / (1 - self.fires_other))
        logit = np.log(self.prior / (1 - self.prior)) + votes @ ((on - off) * self.share) + (off * self.share).sum()
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_label_model(
    votes: np.ndarray, weight: np.ndarray, prior: float, start: np.ndarray | None = None, rounds: int = 60
) -> LabelModel:
    """Expectation maximisation over 0/1 votes with a fixed share of toxic texts, from a first guess.

    After it, voters' correlations among toxic texts are measured, and each voter's evidence is
    divided by one plus the sum of its strong ones (a half or more), so that a word and its
    prefixes count about once.
    """
    n_voters = votes.shape[1]
    guess = np.where(votes.any(axis=1), 0.5, prior / 10) if start is None else start
    model = LabelModel(prior, np.full(n_voters, 0.3), np.full(n_voters, 0.01), np.ones(n_voters))
    for _ in range(rounds):
        toxic, other = guess * weight, (1 - guess) * weight
        up = np.clip((toxic @ votes + 0.1) / (toxic.sum() + 1), 1e-3, 0.99)
        low = np.clip((other @ votes + 0.001) / (other.sum() + 1), 1e-5, 0.5)
        model = LabelModel(prior, up, np.minimum(low, up), np.ones(n_voters))
        new = model.posterior(votes)
        if np.abs(new - guess).max(initial=0) < 1e-6:
            break
        guess = new
    toxic = guess * weight
    centred = votes - model.fires_toxic
    cov = (centred * toxic[:, None]).T @ centred / max(toxic.sum(), 1e-9)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    dependence = np.clip(cov / spread[:, None] / spread[None, :], 0, 1)
    dependence[dependence < 0.5] = 0
    np.fill_diagonal(dependence, 0)
    return LabelModel(prior, model.fires_toxic, model.fires_other, 1 / (1 + dependence.sum(axis=1)))


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels (Adam); returns weights and bias."""
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    weight = weight / weight.sum()
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        e = (p - y) * weight
        g = np.append(x.T @ e + ridge * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


@dataclass(frozen=True)
class ToxicityModel:
    features: list[str]
    weights: np.ndarray
    bias: float


def _candidates(texts: DataFrame, support: float) -> list[str]:
    """Words and prefixes that count in at least that share (and three) of the texts; near copies are one."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = _words(text)
                counts: Counter[str] = Counter()
                for w, n in Counter(words).items():
                    for f in _features(w):
                        counts[f] += n
                found = [f for f, n in counts.items() if n * PER_WORDS >= len(words)]
                sign = pa.array([_signature(words)] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), sign], ["feature", "sign"])

    rows = texts.mapInArrow(emit, "feature string, sign long").distinct()
    counts = rows.groupBy("feature").agg(F.count("*").alias("n"))
    least = max(3.0, support * texts.count())
    return sorted(r["feature"] for r in counts.where(F.col("n") >= least).collect())


def _unnested(features: list[str]) -> list[str]:
    """Leaves out what extends or shortens an earlier feature, as far as that is a prefix pattern."""
    kept: list[str] = []
    for f in features:
        core = f.rstrip("*")
        if not any((g.endswith("*") and core.startswith(g[:-1])) or (f.endswith("*") and g.rstrip("*").startswith(core)) for g in kept):
            kept.append(f)
    return kept


def _matched(sample: DataFrame, features: list[str], shares: tuple[float, ...]) -> DataFrame:
    """(sign, label, hits): the features of the sample's texts; near copies are one."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(features, shares)
        for batch in batches:
            words = [_words(t) for t in batch.column(0).to_pylist()]
            sign, hits = pa.array([_signature(w) for w in words], pa.int64()), pa.array([matcher(w) for w in words], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([sign, batch.column(1).cast(pa.int32()), hits], ["sign", "label", "hits"])

    rows = sample.mapInArrow(match, "sign long, label int, hits array<int>")
    return rows.groupBy("sign").agg(F.max(F.struct("label", "hits")).alias("r")).select("sign", "r.label", "r.hits")


def _sharp(sample: DataFrame, features: list[str], most: int) -> list[str]:
    """Features far likelier in toxic texts than in others, beyond chance, the strongest first; nested ones once."""
    rows = stored(_matched(sample, features, ()), "hits")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_toxic, n_other = max(sizes.get(1, 0), 1), max(sizes.get(0, 0), 1)
    t, c = np.zeros(len(features)), np.zeros(len(features))
    for r in rows.select("label", F.explode("hits").alias("f")).groupBy("label", "f").count().collect():
        (t if r["label"] == 1 else c)[r["f"]] = r["count"]
    odds = np.log((t + 0.5) / (n_toxic - t + 0.5)) - np.log((c + 0.5) / (n_other - c + 0.5))
    gain = t * np.log(((t + 0.5) / (n_toxic + 1)) / ((c + 0.5) / (n_other + 1)))
    picked = np.flatnonzero((odds > 2.5) & (gain > 2 * np.log(len(features) + 1)))
    order = sorted(picked.tolist(), key=lambda i: (-gain[i], -len(features[i]), features[i]))
    return _unnested([features[i] for i in order])[:most]


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    toxic_rows: int = 4000,
    other_rows: int = 12_000,
    lexicon: int = 128,
    support: float = 0.004,
) -> ToxicityModel:
    """Fits voters, label model and classifier on labelled documents.

    Documented bounds: about `toxic_rows` labelled toxic and `other_rows` other documents, chosen
    by hash of their id, and `lexicon` words and patterns. Candidates follow from `support`. The
    share of toxic texts is counted over all given labels. Null ids and labels are left out; a
    document with several labels counts as toxic if one says so. Without toxic texts every score
    is the prior.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    own = own.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    counts = {r["_label"]: r["count"] for r in own.groupBy("_label").count().collect()}
    total = sum(counts.values())
    prior = min(max(counts.get(1, 0) / max(total, 1), 1e-3), 0.5)
    if not counts.get(1):
        return ToxicityModel([], np.zeros(0), float(np.log(prior / (1 - prior))))
    toxic = bounded_sample(own.where("_label = 1"), toxic_rows, "_id")
    other = bounded_sample(own.where("_label = 0"), other_rows, "_id")

    def texts(ids: DataFrame) -> DataFrame:
        # at most the bounded number of ids
        return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "_id")

    sample = stored(texts(toxic.unionByName(other)).select("text", "_label"), "labelled")
    features = _candidates(sample.where("_label = 1").select("text"), support)
    sharp = _sharp(sample, features, lexicon)
    if not sharp:
        return ToxicityModel([], np.zeros(0), float(np.log(prior / (1 - prior))))
    rows = _matched(sample, sharp, SHARES).orderBy("sign").collect()
    y = np.asarray([r["label"] for r in rows])
    x = np.zeros((len(rows), len(sharp) + len(SHARES)))
    for i, r in enumerate(rows):
        x[i, r["hits"]] = 1
    votes = np.column_stack([x, y == 1])  # the annotator is one more voter, whose errors are estimated too
    weight = np.where(y == 1, prior / max((y == 1).sum(), 1), (1 - prior) / max((y == 0).sum(), 1)) * len(y)
    soft = fit_label_model(votes, weight, prior, np.where(y == 1, 0.95, 0.02)).posterior(votes)
    w, b = fit_linear(x, soft, np.sqrt(weight))
    return ToxicityModel(sharp, w, float(b))


def score_toxicity(df: DataFrame, model: ToxicityModel, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """(kept columns, score): probability that a text is toxic, from its whole text alone.

    Null and empty texts have no features and get the classifier's base score. Repeated rows get
    equal scores; the score column must not be among the kept ones; an empty table stays empty.
    """
    shared = sent_once(df.sparkSession, model)  # bounded by the number of features
    own = df.select(*keep, F.col(text_col).cast("string").alias("_score_text"))
    kept = [f for f in own.schema.fields if f.name != "_score_text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        matcher = Matcher(model.features, SHARES if model.features else ())
        for batch in batches:
            hits = (matcher(_words(t.as_py())) for t in batch.column(batch.num_columns - 1))
            logit = np.asarray([model.bias + float(model.weights[h].sum()) for h in hits])
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64())], [*batch.schema.names[:-1], score_col])

    return own.mapInArrow(score, StructType([*kept, StructField(score_col, DoubleType())]))
