"""Phrase index against SQL and against a scan of every window."""

import re

import pytest
from pyspark.sql import functions as F

from oracle import compare, connect
from pflegetakt.llm import decontamination as dc
from pflegetakt.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    assert compare(QUERIES["op7_decontamination"](spark, sf_dir), connect(sf_dir), ORACLE["op7_decontamination"]) == ""


def words(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]


def brute(text, items, window):
    own, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        size = min(window, len(w))
        if name is None or not size:
            continue
        for s in range(len(w) - size + 1):
            for p in range(len(own) - size + 1):
                if own[p : p + size] == w[s : s + size]:
                    hit.update(range(p, p + size))
                    found.add(str(name))
    return len(own), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(own)


ITEMS = [(1, "a b a b a b c"), (2, "É x. y, Z!"), (2, "É x. y, Z!"), (10, "solo"), (3, None), (4, ""), (None, "a b"), (5, "a a a a a a"), (6, "never seen words here")]
TEXTS = [
    "A b a B a b a b c a b a b a",
    "é X y z É x y z",
    "É x y z, É X Y Z",
    "Solo, and the solo",
    None,
    "",
    "...",
    "a a a a a a a a",
    "never seen words not here",
    "q " * 30_000 + "a b a b a b c " + "É x y z",
]


def test_small_cases(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, TEXTS[3])]
    docs = spark.createDataFrame([(i, t, "clash", 5) for i, t in rows], "id long, text string, items string, n_hit int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = dc.contamination(docs, "text", items, "item_id", "text", 4)
    got = dc.with_contamination(docs.drop("n_hit"), "text", found).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == brute(r["text"], ITEMS, 4), r["text"]
    kept = dc.without_contaminated(docs, "text", found)
    assert kept.columns == docs.columns
    wanted = sorted(repr((i, t)) for i, t in rows if not brute(t, ITEMS, 4)[3])
    assert sorted(repr((r["id"], r["text"])) for r in kept.collect()) == wanted
    for a, b in ((docs.limit(0), items), (docs, items.limit(0))):
        nothing = dc.contamination(a, "text", b, "item_id", "text", 4)
        assert nothing.count() == 0
        assert dc.without_contaminated(docs, "text", nothing).count() == len(rows)


def near_brute(text, items, window, near):
    """(words near their places in near windows, items with one) by trying every start of every window."""
    own, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        size = min(window, len(w))
        for s in range(len(w) - size + 1) if size else ():
            for a in range(-size - s - near.slack, len(own) + near.slack):
                at = [
                    [p for p in range(max(0, a + o - near.slack), min(len(own), a + o + near.slack + 1)) if own[p] == w[o]]
                    for o in range(s, s + size)
                ]
                if sum(map(bool, at)) >= size - size * near.missing_percent // 100:
                    hit.update(p for ps in at for p in ps)
                    found.add(name)
    return len(hit), len(found)


LONG = [f"w{i}" for i in range(20)]
NEAR_ITEMS = [*ITEMS, (20, " ".join(LONG)), (21, "one two three four five six seven eight nine ten")]
NEAR_TEXTS = [
    *TEXTS[:-1],
    "one two extra three four five six seven eight nine ten",
    "ten nine eight seven six five four",
    "two one four three six five eight seven ten nine",
    "x " + " ".join(["q" if i in (3, 9) else w for i, w in enumerate(LONG)]) + " y",
    " ".join(["q" if i % 4 == 0 else w for i, w in enumerate(LONG)]),
    " ".join(LONG[2:11]) + " w0 w1",
    "b a b a b c",
]


@pytest.mark.parametrize("near", [dc.Near(), dc.Near(20, 0), dc.Near(30, 2), dc.Near(0, 0)], ids=str)
@pytest.mark.parametrize("window", [4, 10])
def test_proximity(spark, near, window):
    """Words missing, also the rarest ones and those the corpus lacks; words moved, put in, cut off."""
    docs = spark.createDataFrame(list(enumerate(NEAR_TEXTS)) * 2, "id long, text string").withColumn("_k1", F.lit(1))
    items = spark.createDataFrame(NEAR_ITEMS, "item_id long, text string")
    found = dc.contamination(docs, "text", items, "item_id", "text", window, near)
    got = dc.with_contamination(docs, "text", found)
    assert "_k1" in got.columns
    wanted = [near_brute(t, NEAR_ITEMS, window, near) for t in NEAR_TEXTS]
    exact = [brute(t, ITEMS + NEAR_ITEMS[-2:], window) for t in NEAR_TEXTS]
    for r in got.collect():
        assert (r["n_near"], r["n_near_items"]) == wanted[r["id"]], r["text"]
        assert r["items"] == exact[r["id"]][2]
        if near != dc.Near(0, 0):
            assert r["n_near"] >= r["n_hit"]


def test_long_items_unfold_their_windows_only(spark):
    """Texts that quote 13 words of an item of 20,000 cost some windows each, not the item."""
    item = " ".join(f"t{i}" for i in range(20_000))
    quote = F.concat_ws(" ", F.transform(F.sequence(F.col("id") * 20, F.col("id") * 20 + 12), lambda i: F.concat(F.lit("t"), i)))
    docs = spark.range(900).select(F.concat(F.lit("x "), quote, F.lit(" y")).alias("text"))
    terms = dc.item_terms(spark.createDataFrame([("i", item)], "item string, words string"), "item", "words")
    index = dc.build_index(docs, "text", terms)
    aligned = dc.alignments(index, terms, 13)
    assert aligned.selectExpr("sum(high - low) as n").first()["n"] == 900 * 13
    assert dc.phrase_hits(dc.aligned_terms(index, terms, 13), 13).count() == 900


def test_shared_and_missing_ids_equal_sql(spark, tmp_path):
    """Rows of one id with different texts, one text with several ids, rows without an id."""
    long = [f"w{i}" for i in range(13)]
    other = [*long[:6], "x6", *long[7:]]
    items = [
        (1, " ".join(long)),
        (1, " ".join(other)),
        (2, " ".join(long)),
        (3, "k0 " + " ".join(f"r{i}" for i in range(14))),
        (3, "k0 " + " ".join(f"s{i}" for i in range(14))),
        (None, "alone without id"),
        (None, " ".join(long)),
        (4, "alone, WITHOUT id!"),
        (None, "nobody"),
        (None, None),
    ]
    texts = [
        " ".join(long),
        "a " + " ".join(other) + " b",
        "k0 " + " ".join(f"r{i}" for i in range(12)),
        "k0 " + " ".join(f"s{i}" for i in range(12)) + " r12",
        "alone without id",
        "nobody knows " + "z " * 10,
        "r0 s0 w6 x6 k0",
        None,
        " ".join([*long, *other]),
        " ".join(["q" if w in ("w2", "w7") else w for w in long]),
        " ".join([*long[:5], "between", *long[5:]]),
        " ".join(["q" if i % 4 == 0 else w for i, w in enumerate(long)]),
    ] + ["x6 w6 r0 s1 r1"] * 3
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "b"))
    for folder, name in (("d", "documents"), ("b", "benchmark")):
        next((tmp_path / folder).glob("part-*")).rename(tmp_path / f"{name}.parquet")
    frame = QUERIES["op7_decontamination"](spark, str(tmp_path))
    assert compare(frame, connect(str(tmp_path)), ORACLE["op7_decontamination"]) == ""
    hit = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in frame.collect()}
    assert (hit[0], hit[1], hit[5]) == ((13, 3), (13, 1), (1, 1))
    near = {r["doc_id"]: (r["n_near"], r["n_near_items"]) for r in frame.collect()}
    assert (near[9], near[10], near[11]) == ((11, 3), (13, 3), (0, 0))
