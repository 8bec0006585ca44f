"""Label model, matcher and held-out scores."""

import numpy as np

from pflegetakt.llm import toxicity as tx
from pflegetakt.llm.queries import QUERIES


def test_label_model_finds_rates_and_dependence():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.2
    up, low = np.asarray([0.6, 0.5, 0.7, 0.4, 0.55]), np.asarray([0.02, 0.05, 0.01, 0.03, 0.02])
    votes = (rng.random((len(y), 5)) < np.where(y[:, None], up, low)).astype(float)
    votes = np.column_stack([votes, votes[:, 0]])  # a copy of the first voter
    model = tx.fit_label_model(votes, np.ones(len(y)), 0.2)
    assert np.abs(model.fires_toxic[1:5] - up[1:]).max() < 0.06
    assert np.abs(model.fires_other[1:5] - low[1:]).max() < 0.03
    assert model.share[0] < 0.6 and model.share[5] < 0.6 and model.share[2] > 0.9
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.95


def test_linear_separates():
    rng = np.random.default_rng(1)
    x = (rng.random((2000, 6)) < 0.3).astype(float)
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    w, b = tx.fit_linear(x, y, np.ones(len(y)))
    assert ((x @ w + b > 0) == (y > 0.5)).mean() > 0.99


def test_matcher_counts_by_density():
    match = tx.Matcher(["idiot", "lowe*"], (0.01,))
    assert match(tx._words("An IDIOT! loweish")) == [0, 1, 2]
    assert match(tx._words("idiot " + "plain " * 500)) == []
    assert match([]) == []


def test_held_out_scores(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op8_toxicity"](spark, sf_dir).collect()]
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 for r in rows)
    own = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic = [r["predicted"] for r in own if labels[r["doc_id"]] == 1]
    clean = [r["predicted"] for r in own if labels[r["doc_id"]] == 0]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.02


def test_edges(spark):
    def name(i):
        return "".join("bcdfghklmn"[int(d)] for d in f"{i:04}") * 2

    docs = [(i, f"you idiot {name(i)} {name(i + 500)}") for i in range(30)]
    docs += [(100 + i, f"calm words {name(100 + i)} {name(700 + i)}") for i in range(200)]
    docs += [(None, "idiot"), (999, None), (998, ""), (997, "idiot " * 200_000), docs[0]]
    frame = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, _label string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(i, 0) for i in range(30)] + [(100 + i, 0) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = tx.fit_toxicity(frame, labels)
    assert "idiot" in model.features or any("idiot".startswith(f[:-1]) for f in model.features if f.endswith("*"))
    rows = tx.score_toxicity(frame, model, ["doc_id"]).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["score"] >= 0.3) == (r["doc_id"] is None or r["doc_id"] < 30 or r["doc_id"] == 997), r
    assert tx.score_toxicity(frame.limit(0), model, ["doc_id"]).count() == 0
    base = tx.fit_toxicity(frame, labels.limit(0))
    assert len({r["score"] for r in tx.score_toxicity(frame, base, ["doc_id"]).collect()}) == 1
