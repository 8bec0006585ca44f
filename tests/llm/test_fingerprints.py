"""Fingerprints and permuted block tables against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from pflegetakt.llm import fingerprints as fp
from pflegetakt.llm.queries import QUERIES


def brute(text):
    votes, total = [0] * 64, 0
    for word in re.split("[\x20\x09-\x0d]+", text or ""):
        h, total = xxhash.xxh64_intdigest(word.lower().encode(), seed=42), total + len(word)
        for b in range(64):
            votes[b] += len(word) * (h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > total)


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    marks = [brute(t) for _, t in docs]
    rows = {r["doc_id"]: r for r in QUERIES["op6_document_fingerprints"](spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for i, (doc, text) in enumerate(docs):
        after = (i + 1) % len(docs)
        take = len(text) // 4
        edited = text[: len(text) - take] + docs[after][1][:take]
        r = rows[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f"{marks[i]:016x}", f"{brute(edited):016x}")
        assert r["near_edited"] == 1 - (marks[i] ^ brute(edited)).bit_count() / 64
        assert r["near_next"] == 1 - (marks[i] ^ marks[after]).bit_count() / 64
        near = sum((marks[i] ^ m).bit_count() <= 3 for m in marks) - 1
        assert r["n_near"] == (near if doc % 20 == 0 else None)


def test_edges(spark, tmp_path):
    docs = [(None, "null id"), (7, None), (7, None), (7, ""), (8, " \n"), (9, "ab cd"), (9, "ab cd"), (20, "Ab  CD"), (21, "x" * 100_000 + " y")]
    frame = spark.createDataFrame([(d, t, "clash", 0) for d, t in docs], "doc_id long, text string, fingerprint string, n_chars int")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op6_document_fingerprints"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in rows) == sorted((d or -1, len(t or "")) for d, t in docs)
    by = {(r["doc_id"], r["n_chars"]): r for r in rows}
    assert by[(7, 0)]["fingerprint"] == by[(8, 2)]["fingerprint"] == "0" * 16
    assert by[(9, 5)]["fingerprint"] == by[(20, 6)]["fingerprint"] == f"{brute('ab cd'):016x}"
    assert by[(20, 6)]["n_near"] == 2
    assert by[(9, 5)]["edited_sha256"] == hashlib.sha256(b"ab cA").hexdigest()
    last = by[(21, 100_002)]
    assert last["edited_sha256"] == hashlib.sha256(("x" * 75_002 + "null id").encode()).hexdigest()
    frame.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert QUERIES["op6_document_fingerprints"](spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize(("radius", "blocks"), [(0, 1), (1, 2), (3, 4), (3, 6), (5, 7)])
def test_block_tables_find_all(spark, radius, blocks):
    rng = np.random.default_rng(radius)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)]
    others = []
    for x in base:
        for n in range(7):
            y = x
            for b in rng.choice(64, n, replace=False):
                y ^= (1 << int(b)) - ((1 << 64) if b == 63 else 0)
            others.append(y)
    every = sorted(set(base + others))
    frame = spark.createDataFrame([(x,) for x in [*every, *every[:5], None]], "fingerprint long")
    got = [(r["query"], r["fingerprint"]) for r in fp.near_fingerprints(frame, frame, radius, blocks).collect()]
    wanted = {(a, b) for a in every for b in every if ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
    assert len(got) == len(set(got)) and set(got) == wanted


def test_followers(spark):
    keys = [(i * 37 % 101, i % 3) for i in range(90)] + [(5, 1), (5, 1)]
    frame = spark.createDataFrame([(a, b, "x") for a, b in keys], "a long, b long, c string")
    order = sorted(set(keys))
    got = {(r["a"], r["b"]): (r["next_a"], r["next_b"]) for r in fp.followers(frame, ["a", "b"]).collect()}
    assert got == {k: order[(i + 1) % len(order)] for i, k in enumerate(order)}
    assert fp.followers(frame.limit(0), ["a", "b"]).count() == 0
