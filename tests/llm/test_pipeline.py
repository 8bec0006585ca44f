"""The pipeline: every stage's effect against brute force, on documents with all kinds of cases."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from pflegetakt.llm import mixing, near_duplicates
from pflegetakt.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage gets and returns."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns(steps):
    columns = steps[0][1].columns
    assert [df.columns for _, df in steps[:-1]] == [columns] * 5
    assert steps[-1][1].columns == [*columns, "shard", "grown_shard"]


def test_toxic_documents_go(spark, steps):
    scored = {r["doc_id"]: r["predicted"] for r in QUERIES["op8_toxicity"](spark, SF_DIR).collect()}
    assert ids(steps[1][1]) == sorted(i for i, p in scored.items() if not p)
    assert 0 < sum(scored.values()) < 200


def test_one_of_each_group_stays(spark, steps):
    found = near_duplicates.near_duplicates(steps[1][1], "doc_id", "text").collect()
    assert ids(steps[2][1]) == sorted({r["component_id"] for r in found})


def words(text):
    lowered = text.translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]


def test_contaminated_documents_go(spark, steps):
    windows = set()
    for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    assert all(len(w) == 13 for w in windows)
    kept = []
    for r in steps[2][1].collect():
        w, hit = words(r["text"]), set()
        for i in range(len(w) - 12):
            if tuple(w[i : i + 13]) in windows:
                hit.update(range(i, i + 13))
        if not hit or 20 * len(hit) < len(w):
            kept.append(r["doc_id"])
    assert ids(steps[3][1]) == sorted(kept)
    assert len(kept) < steps[2][1].count()


def test_mixing_keeps_every_document(steps):
    before, after = ids(steps[3][1]), ids(steps[4][1])
    assert set(after) == set(before) and len(before) < len(after) < 3 * len(before)
    text = {r["doc_id"]: r["text"] for r in steps[3][1].collect()}
    assert all(text[r["doc_id"]] == r["text"] for r in steps[4][1].collect())


def test_copies_follow_the_rates_of_the_fit(spark, steps):
    model = corpus_pipeline.domain_model(spark, SF_DIR)
    rows, mix = mixing.mix_documents(steps[3][1], model, "doc_id", "text", power=corpus_pipeline.MIX_POWER, keep_all=True)
    wanted = sorted((r["doc_id"], r["copies"]) for r in rows.collect())
    got = Counter(ids(steps[4][1]))
    assert [(i, got[i]) for i, _ in wanted] == wanted
    assert mix.residual < 0.02


def test_mixing_moves_no_text(spark, steps):
    """No join and no shuffle above the scoring of the rows, so the plan is the same at every size."""
    model = corpus_pipeline.domain_model(spark, SF_DIR)
    _, mix = mixing.mix_documents(steps[3][1], model, "doc_id", "text", keep_all=True)
    plan = mixing.repeat_by_rate(steps[3][1], model, mix, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_shards(steps):
    assert ids(steps[5][1]) == ids(steps[4][1])
    rows = steps[5][1].select("shard", "grown_shard").collect()
    assert {r["shard"] for r in rows} == set(range(16))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows)


def test_stages_take_odd_rows(spark, steps):
    rows = [(None, None, None, None, None), (None, "alone without a number", "en", None, 3), (5, "", None, "s", 0), (5, "", None, "s", 0), (6, "x " * 100_000, "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, n_hit string, copies string, posteriors int, _id int, _key int, _copies int, _k1 int, _toxicity string, row string, rate int"
    odd = spark.createDataFrame([(*r, "a", "b", "c", 1, 2, 3, 4, 5, "d", "e", 6) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, SF_DIR)
        assert stage(spark, odd.limit(0), SF_DIR).count() == 0
        if name == "near_duplicates":
            assert sorted(str(r["text"])[:5] for r in got.collect()) == ["", "alone", "x x x"]
        else:
            assert {str(r["text"])[:5] for r in got.collect()} == {"None", "", "alone", "x x x"}
        if name != "sharding":
            assert got.columns == odd.columns
            assert {tuple(r) for r in got.select(*odd.columns[5:]).collect()} == {("a", "b", "c", 1, 2, 3, 4, 5, "d", "e", 6)}
