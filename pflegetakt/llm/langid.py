"""Language identification with n-gram Bloom filters that hold one bit per language.

The filters of all languages share one array of slots; bit l of a slot belongs to language l
(bit-sliced). One lookup, the AND of an n-gram's slots, yields every language whose profile has
the n-gram. A text's counts per language are corrected for the filters' false positives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import Once, bounded_sample, sent_once

ORDERS = (2, 3, 4)
CHUNK = 1 << 18


@Once
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    raw = text.lower().encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def ngram_hashes(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order (starts, hashes) of the n-grams within words, word edges included.

    All that is no letter counts as one edge sign; n-grams inside runs of edges are left out.
    """
    letter = _letters()[codes]
    signs = np.where(letter, codes, 0).astype(np.uint64)
    rolling = signs + np.uint64(1)
    for n in range(2, max(ORDERS) + 1):
        m = len(signs) - n + 1
        if m <= 0:
            return
        rolling = _mix(rolling[:m] * np.uint64(0x100000001B3) + signs[n - 1 :])
        if n in ORDERS:
            good = letter[:m] | letter[1 : m + 1]
            for inner in range(1, n - 1):
                good &= letter[inner : m + inner]
            starts = np.flatnonzero(good)
            yield starts, rolling[starts] + np.uint64(n)


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, text numbers) of many texts at a time; edges between texts, long ones cut.

    Cuts overlap by one n-gram less a sign, so each n-gram is seen exactly once.
    """
    parts, owners, size = [], [], 0
    lap = max(ORDERS) - 1
    for i, text in enumerate(texts):
        codes = np.concatenate(([32], _codes(text), [32] * lap)) if text else np.empty(0, np.uint32)
        for at in range(0, max(len(codes) - lap, 0), CHUNK):
            part = codes[at : at + CHUNK + lap].astype(np.uint32)
            # lap signs at the end only complete n-grams that begin before them
            parts.append(part)
            owners.append((i, len(part), min(CHUNK, len(part) - lap)))
            size += len(part)
            if size >= CHUNK:
                yield _joined(parts, owners)
                parts, owners, size = [], [], 0
    if parts:
        yield _joined(parts, owners)


def _joined(parts: list[np.ndarray], owners: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    who = np.concatenate([np.where(np.arange(n) < own, i, -1) for i, n, own in owners])
    return np.concatenate(parts), who


def profile_counts(train: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n): how often each n-gram occurs in each language's training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.asarray(batch.column(0).to_pylist(), dtype=object)
            texts = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                found = []
                for codes, who in _pieces([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                    for starts, grams in ngram_hashes(codes):
                        found.append(np.unique(grams[who[starts] >= 0], return_counts=True))
                if found:
                    grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([c for _, c in found])).astype(np.int64)
                    for lo in range(0, len(grams), 1 << 16):
                        g = grams[lo : lo + (1 << 16)].view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(g)), pa.array(g), pa.array(n[lo : lo + (1 << 16)])], ["lang", "gram", "n"]
                        )

    counted = train.select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class LanguageFilters:
    """Slots (rows) of language bits (64-bit words), and each language's false-positive rate."""

    langs: tuple[str, ...]
    slots: np.ndarray
    false_rate: np.ndarray
    hashes: int

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        """Language bits of each n-gram: the AND of its slots."""
        mask = np.uint64(len(self.slots) - 1)
        bits = self.slots[(grams & mask).astype(np.int64)]
        for k in range(1, self.hashes):
            grams = _mix(grams + np.uint64(k))
            bits = bits & self.slots[(grams & mask).astype(np.int64)]
        return bits


def build_filters(profiles: dict[str, np.ndarray], hashes: int = 2, slots_per_gram: int = 24) -> LanguageFilters:
    """Filters of the given n-gram profiles; their size follows from the largest profile."""
    langs = tuple(sorted(profiles))
    most = max((len(p) for p in profiles.values()), default=1)
    size = 1 << max(10, int(most * slots_per_gram - 1).bit_length())
    slots = np.zeros((size, max(1, -(-len(langs) // 64))), np.uint64)
    mask = np.uint64(size - 1)
    for i, lang in enumerate(langs):
        grams = profiles[lang]
        for k in range(hashes):
            if k:
                grams = _mix(grams + np.uint64(k))
            slots[(grams & mask).astype(np.int64), i // 64] |= np.uint64(1) << np.uint64(i % 64)
    fill = [float(((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(langs))]
    return LanguageFilters(langs, slots, np.asarray(fill) ** hashes, hashes)


def fit_language_filters(
    train: DataFrame, id_col: str, text_col: str, lang_col: str, profile: int = 6000, sample: int = 20_000
) -> LanguageFilters:
    """Profiles of the most frequent n-grams per language, put into bit-sliced Bloom filters.

    Texts and languages that are null are left out. Documented bounds: about `sample` training
    rows (by hash, whatever the file order) and `profile` n-grams a language; each language has
    as many at most, so that none is favoured. Spark counts; the driver gets the profiles only.
    Ties of frequency go by hash value.
    """
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = bounded_sample(rows.select(id_col, lang_col, text_col), sample, id_col, text_col)
    counts = profile_counts(rows, text_col, lang_col)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= profile).groupBy("lang").agg(F.collect_list("gram").alias("grams"))
    return build_filters({r["lang"]: np.asarray(r["grams"], np.int64).view(np.uint64) for r in top.collect()})


def count_languages(filters: LanguageFilters, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of each text, n-grams of each text per language filter)."""
    total = np.zeros(len(texts), np.int64)
    per = np.zeros((len(texts), len(filters.langs)), np.int64)
    for codes, who in _pieces(texts):
        for starts, grams in ngram_hashes(codes):
            owner = who[starts]
            grams, owner = grams[owner >= 0], owner[owner >= 0]
            if not len(owner):
                continue
            bits = filters.lookup(grams)
            lo = int(owner.min())
            span = int(owner.max()) - lo + 1
            total[lo : lo + span] += np.bincount(owner - lo, minlength=span)
            for i in range(len(filters.langs)):
                hit = (bits[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                per[lo : lo + span, i] += np.bincount((owner - lo)[hit.astype(bool)], minlength=span)
    return total, per


def _decide(filters: LanguageFilters, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    total, per = count_languages(filters, texts)
    names = np.asarray([*filters.langs, "und"], dtype=object)
    if not filters.langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    rate = np.minimum(filters.false_rate, 0.999)
    true = np.maximum(per - total[:, None] * rate, 0) / (1 - rate)
    best = true.argmax(axis=1)
    score = true[np.arange(len(texts)), best] / np.maximum(true.sum(axis=1), 1e-9)
    spoken = np.fromiter((bool(t) and any(map(str.isalpha, t)) for t in texts), bool, len(texts))
    return list(names[np.where(spoken, best, len(filters.langs))]), np.where(spoken, np.clip(score, 0, 1), 0.0)


def predict_language(df: DataFrame, filters: LanguageFilters, keep: list[str], text_col: str) -> DataFrame:
    """(kept columns, lang_pred, score): the language with most n-grams, false positives deducted.

    Whole texts count, in pieces of bounded size. `und` with score 0 for null texts and texts
    without a letter; texts whose n-grams no filter knows get the first language and score 0,
    as ties go to the first language by name. Repeated rows get equal answers; only the named
    columns are read, an empty table gives an empty one.
    """
    shared = sent_once(df.sparkSession, filters)  # size fixed by languages x profile
    own = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    kept = [f for f in own.schema.fields if f.name != "_text"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_filters = shared()
        for batch in batches:
            langs, scores = _decide(own_filters, batch.column(batch.num_columns - 1).to_pylist())
            columns = [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score"])

    return own.mapInArrow(predict, StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
