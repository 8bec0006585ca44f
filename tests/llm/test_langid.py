"""Language filters: exact lookups, corrected counts, held-out accuracy."""

import numpy as np

from pflegetakt.llm import langid
from pflegetakt.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def grams(text):
    found = []
    for codes, who in langid._pieces([text]):
        for starts, hashes in langid.ngram_hashes(codes):
            found += hashes[who[starts] >= 0].tolist()
    return sorted(found)


def test_filters_never_miss_and_rarely_err():
    rng = np.random.default_rng(0)
    profiles = {f"l{i:02}": rng.integers(0, 2**63, 500, dtype=np.uint64) for i in range(70)}
    filters = langid.build_filters(profiles)
    for i, lang in enumerate(filters.langs):
        bits = filters.lookup(profiles[lang])
        assert ((bits[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()
    other = filters.lookup(rng.integers(0, 2**63, 20_000, dtype=np.uint64))
    rate = np.mean([((other[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(70)])
    assert abs(rate - filters.false_rate.mean()) < 0.002


def test_long_texts_are_counted_whole(monkeypatch):
    text = "Ünder the brîdge 7 sàt — ein Vogel. " * 40
    whole = grams(text)
    monkeypatch.setattr(langid, "CHUNK", 50)
    assert grams(text) == whole
    assert grams("") == [] and grams("1 2 !") == []


def test_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op10_language_id"](spark, SF_DIR).collect()
    assert len(rows) == len(lang)
    own = [r for r in rows if r["held_out"]]
    assert len(own) > 200
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in own]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges(spark):
    train = [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de"), (None, "en"), ("x", None)])]
    frame = spark.createDataFrame(train, "id long, text string, lang string")
    filters = langid.fit_language_filters(frame, "id", "text", "lang")
    assert filters.langs == ("de", "en")
    rows = [(1, None), (2, ""), (3, "42 !"), (4, "the dog"), (4, "the dog"), (None, "und die katze"), (5, "the dog and " * 100_000)]
    asked = spark.createDataFrame([(a, b, "clash", 0.5) for a, b in rows], "id long, text string, lang_pred string, score double")
    got = langid.predict_language(asked, filters, ["id"], "text").collect()
    assert [r["lang_pred"] for r in got] == ["und", "und", "und", "en", "en", "de", "en"]
    assert langid.predict_language(asked.limit(0), filters, ["id"], "text").count() == 0
    nothing = langid.fit_language_filters(frame.limit(0), "id", "text", "lang")
    assert {r["lang_pred"] for r in langid.predict_language(asked, nothing, ["id"], "text").collect()} == {"und"}
