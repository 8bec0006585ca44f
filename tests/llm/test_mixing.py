"""Rates against targets and a dense solver; domain posteriors; copies."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from pflegetakt.llm import mixing
from pflegetakt.llm.queries import QUERIES


def scored(spark, p, tokens):
    rows = [(i, int(t), [float(x) for x in q]) for i, (q, t) in enumerate(zip(p, tokens, strict=True))]
    return spark.createDataFrame(rows, "id long, n_tokens long, posteriors array<double>")


def test_fit_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    tokens = rng.integers(0, 500, 400)
    frame = scored(spark, p, tokens)
    weights = {"a": 0.6, "b": 0.3, "c": 0.1}
    mix = mixing.fit_mix(frame, ("a", "b", "c"), weights, rounds=60, tolerance=1e-4)
    assert np.abs(mix.reached / mix.targets - 1).max() < 1e-3
    assert np.isclose(mix.targets.sum(), tokens.sum())
    rates = np.ones(400)  # the same descent on the dense matrix
    a = (p * tokens[:, None]).T
    for _ in range(len(mix.steps)):
        rates = np.maximum(rates - p @ ((a @ rates - mix.targets) / (a @ np.ones(400))), 0)
    got = {r["id"]: r for r in mixing.with_rates(frame, mix, ["id"], ["id"]).collect()}
    assert np.allclose([got[i]["rate"] for i in range(400)], rates) and rates.min() >= 0
    for r in got.values():
        assert r["copies"] in (int(r["rate"]), int(r["rate"]) + 1)
    assert abs(sum(r["copies"] for r in got.values()) - rates.sum()) < 4 * np.sqrt(400)


def test_keep_all_never_drops(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.06, 0.02], 300)  # nearly sure posteriors, so that the targets can be met
    frame = scored(spark, p, np.full(300, 100))
    mix = mixing.fit_mix(frame, ("a", "b"), power=0.3, keep_all=True)
    rows = mixing.with_rates(frame, mix, ["id"], ["id"]).collect()
    assert min(r["rate"] for r in rows) >= 1 and min(r["copies"] for r in rows) >= 1
    share = mix.reached / mix.reached.sum()
    assert np.allclose(share, mixing.tempered(mix.natural, 0.3), atol=0.02)


def test_unreachable_targets_stay_nonnegative(spark):
    frame = scored(spark, [[0.9, 0.1]] * 50, [10] * 50)
    mix = mixing.fit_mix(frame, ("a", "b"), {"b": 1.0})
    assert min(r["rate"] for r in mixing.with_rates(frame, mix, ["id"], ["id"]).collect()) >= 0


def plain_features(text):
    """Every word by itself."""
    words = text.split()
    n, at = max(len(words), 1), {}
    for w in words:
        bucket = zlib.crc32("".join(c for c in w if c.isalpha()).lower().encode()) % mixing.BUCKETS
        at[bucket] = at.get(bucket, 0) + 1
    value = np.log1p([at[b] for b in sorted(at)])
    shapes = [
        1,
        sum(w.isupper() for w in words) / n,
        sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words) / n,
        sum(not any(c.isalnum() for c in w) for w in words) / n,
        1 - len(set(words)) / n,
        sum(w[0].isdigit() for w in words) / n,
        min(np.log1p(len(words)) / 10, 2.0),
        0,
    ]
    return len(words), [*sorted(at), *range(mixing.BUCKETS, mixing.BUCKETS + 8)], [*value / (np.sqrt((value**2).sum()) + 1e-9), *shapes]


def test_features_of_a_text_need_no_table_of_words():
    """A text is cleaned as a whole, in Latin-1 or not; each word counts as if cleaned alone."""
    rng = random.Random(3)
    texts = ["", " \n", "ΑΣ1Β ΑΣ, Σ. x\u0301 ǅ; İ ẞ", "A A. B- 1a ² ٣ -- µ ª × a\x85b"]
    for letters in ("aAß1².,;-_!ÄµªÜ×", "aAß1²٣.,;-_!\u0301Σǅ؟字"):
        texts += [" ".join("".join(rng.choices(letters, k=rng.randrange(1, 5))) for _ in range(30)) for _ in range(50)]
    for text in texts:
        n, at, value = mixing.text_features(text)
        plain = plain_features(text)
        order = np.argsort(at)
        assert n == plain[0] and at[order].tolist() == plain[1] and np.allclose(value[order], plain[2], rtol=1e-12)
    assert mixing.text_features(None)[0] == 0


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op1_mixing"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    p, n = np.asarray([r["posteriors"] for r in rows]), np.asarray([r["n_tokens"] for r in rows])
    rate = np.asarray([r["rate"] for r in rows])
    assert [r["n_tokens"] for r in rows] == [len(docs[r["doc_id"]]["text"].split()) for r in rows]
    assert np.allclose(p.sum(axis=1), 1) and rate.min() >= 0
    natural = n @ p
    targets = mixing.tempered(natural, 0.7) * natural.sum()
    assert np.abs((n * rate) @ p - targets).max() < 2e-3 * natural.sum()


def test_edges(spark):
    train = [(i, "alpha beta " * (i + 1), "a") for i in range(20)] + [(50 + i, "gamma delta " * (i + 1), "b") for i in range(20)] + [(99, "x", None)]
    model = mixing.fit_domains(spark.createDataFrame(train, "id long, text string, domain string"), "text", "domain", "id")
    assert model.domains == ("a", "b")
    docs = [(1, "alpha beta"), (1, "alpha beta"), (None, "gamma"), (3, None), (4, ""), (5, "delta " * 200_000)]
    frame = spark.createDataFrame([(d, t, 0.5, "clash") for d, t in docs], "doc_id long, text string, rate double, posteriors string")
    rows, _ = mixing.mix_documents(frame, model, "doc_id", "text")
    got = rows.collect()
    assert len(got) == len(docs)
    for r in got:
        if r["doc_id"] == 1:
            assert r["posteriors"][0] > 0.8
        if r["doc_id"] in (3, 4):
            assert r["n_tokens"] == 0
    assert len({(r["rate"], r["copies"]) for r in got if r["doc_id"] == 1}) == 1
    nothing, mix = mixing.mix_documents(frame.limit(0), model, "doc_id", "text")
    assert nothing.count() == 0 and mix.targets.sum() == 0
    alone = mixing.fit_domains(spark.createDataFrame(train[-1:], "id long, text string, domain string"), "text", "domain", "id")
    assert alone.domains == ("all",)
    assert rows.select(F.sum("copies")).first()[0] >= 0
