"""Trie self-join, components and SimHash against brute force."""

import re

import numpy as np
import pytest
import xxhash

from pflegetakt.llm import near_duplicates as near
from pflegetakt.llm.components import components
from pflegetakt.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def apart(a, b):
    return int(a ^ b).bit_count()


def brute_simhash(text, width=4):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w]
    runs = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(ids, fingerprints, budget):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if apart(fingerprints[i], fingerprints[j]) <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {i: min((x for x in groups[find(k)] if x is not None), default=None) for k, i in enumerate(ids)}


@pytest.mark.parametrize("upper", [0, 1, 2, 4])
def test_traversal_equals_all_pairs(upper):
    rng = np.random.default_rng(upper)
    x = rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2)
    flips = [np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64) for _ in range(3)]
    x = np.unique(np.concatenate([x, x[0] ^ flips[0] ^ flips[1], x[1] ^ flips[2]]))
    wanted = {
        (i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if apart(x[i], x[j]) <= 4 and apart(x[i] >> np.uint64(32), x[j] >> np.uint64(32)) <= upper
    }
    got = [p for i, j in near.traverse(x, x, upper, 4) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_small_pieces_give_the_same(monkeypatch):
    rng = np.random.default_rng(9)
    x = np.unique(rng.integers(0, 2**20, 400, dtype=np.uint64) << np.uint64(30))
    a, b = x[::2].copy(), x[1::2].copy()
    whole = {p for i, j in near.traverse(a, b, 2, 4) for p in zip(i.tolist(), j.tolist(), strict=True)}
    monkeypatch.setattr(near, "FRONTIER", 7)
    monkeypatch.setattr(near, "LEAF_PAIRS", 1)
    assert {p for i, j in near.traverse(a, b, 2, 4) for p in zip(i.tolist(), j.tolist(), strict=True)} == whole


@pytest.mark.parametrize("node_keys", [1 << 15, 9])
def test_links_connect_what_all_pairs_connect(spark, node_keys):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63 - 1, 60)
    keys = [int(k) for k in base]
    for k in keys[:20]:
        for _ in range(6):  # a chain away from k
            k ^= (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63)))
            keys.append(k)
    keys = sorted(set(keys))
    frame = spark.createDataFrame([(k,) for k in keys] * 2, "fingerprint long")
    links = near.near_links(frame, 4, node_keys).collect()
    assert all(apart(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) <= 64 for r in links)
    roots = {r["node"]: r["root"] for r in components(near.near_links(frame, 4, node_keys)).collect()}
    wanted = brute_components(keys, [k & (2**64 - 1) for k in keys], 4)
    assert {k: roots.get(k, k) for k in keys} == wanted


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 1), (200, None), (301, 300), (300, 301)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()
    marks = [brute_simhash(d["text"]) for d in docs]
    wanted = brute_components([d["doc_id"] for d in docs], marks, 4)
    rows = QUERIES["op5_simhash_near_dedup"](spark, SF_DIR).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {
        d["doc_id"]: (f"{m:016x}", wanted[d["doc_id"]]) for d, m in zip(docs, marks, strict=True)
    }


LONG = " ".join(f"w{i * i}" for i in range(200_000))
CASES = [(5, None), (3, ""), (None, " \t"), (8, "a b"), (8, "a b"), (2, "A b"), (None, "quite alone here"), (9, LONG), (11, LONG + "x")]


def test_edges(spark):
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in CASES], "id long, text string, fingerprint string, component_id int")
    rows = near.near_duplicates(frame, "id", "text").collect()
    assert len(rows) == len(CASES)
    by_text = sorted((r["fingerprint"], r["component_id"]) for r in rows)
    assert by_text.count((0, 3)) == 3
    assert {r["component_id"] for r in rows if r["id"] == 8} == {2}
    assert {r["component_id"] for r in rows if r["id"] in (9, 11)} == {9}
    kept = near.keep_one_each(frame, "id", "text")
    assert kept.columns == frame.columns
    assert sorted((r["id"] or -1, r["text"][:12]) for r in kept.collect()) == [(-1, "quite alone "), (2, "A b"), (3, ""), (9, "w0 w1 w4 w9 ")]
    assert near.keep_one_each(frame.limit(0), "id", "text").count() == 0


def test_simhash_equals_brute_force():
    for text in ("", "one", "one two three", "É É e E x\x0by\x0cz " * 9, "A b C d e F g"):
        assert near.simhash(text.encode(), 4) == brute_simhash(text)
