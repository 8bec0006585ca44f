"""Prefix trie against brute force, in one part and in many."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from oracle import compare, connect
from pflegetakt.llm import prefix_trie as trie
from pflegetakt.llm.common import stored
from pflegetakt.llm.queries import ORACLE, QUERIES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    ordered = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            ordered[conv].append((turn is not None, turn or 0, digest, role, text))
    first = {c: [x[3:] for x in sorted(turns)] for c, turns in ordered.items()}
    rebuilt = {}
    for c in first:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = first.get(c - c % 20, [])[:h] + first[c][h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        own = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own
            leaves[node[:d]] += not children[node]

    def ends(node):
        return hashlib.sha256(",".join(str(c) for c in sorted(members[node]) if len(rebuilt[c]) == len(node)).encode()).hexdigest()

    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(children[n]), leaves[n], saved[n], ends(n)) for n, m in members.items())


def built(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "c long, t long, r string, x string, digest string, depth string")
    numbered = stored(trie.numbered_turns(frame, "c", "t", "r", "x"), "numbered")
    found = trie.prefix_trie(*trie.regrafted(numbered, 20, 3), **options).select(*COLUMNS).collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in found)


def some_rows(seed):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(0, 70), 400, 401, 417]:  # group 400 has its first conversation, others lack turns
        for t in range(rnd.randint(1, 6)):
            rows.append((c, t, rnd.choice(["user", "assistant"]), rnd.choice(["a", "a b", "", " c\td "])))
    rows += [(7, None, None, None), (7, 0, "user", "tie"), (None, 1, "user", "lost"), (8, 3, "user", "twice"), (8, 3, "user", "twice")]
    rows += [(c, t, "user", "same opening") for c in range(1000, 1200) for t in range(2)]  # a hot path
    rows += [(3001, t, "user", f"deep {t % 3}") for t in range(300)] + [(3002, 0, "user", "word " * 20_000)]
    return rows


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert compare(QUERIES["op12_prefix_trie"](spark, sf_dir), connect(sf_dir), ORACLE["op12_prefix_trie"]) == ""


@pytest.mark.parametrize("options", [{}, {"heavy": 3, "layer": 7, "shard_rows": 40}])
def test_equals_brute_force(spark, options):
    rows = some_rows(3)
    assert built(spark, rows, **options) == brute(rows)


def test_no_rows_and_turnless_conversations(spark):
    assert built(spark, []) == []
    assert built(spark, [(None, 1, "user", "lost")]) == []
    lone = next(c for c in range(21, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lone, 0, "user", "x")]  # no first conversation to take from
    assert built(spark, rows) == brute(rows) and len(brute(rows)) == 1


def test_perfect_hash_fills_all_slots_and_unknown_keys_are_noticed():
    rnd = np.random.default_rng(0)
    a, b = rnd.integers(0, 1 << 62, (2, 20_000)).astype(np.uint64)
    hashed = trie.PerfectHash(a, b)
    slots = hashed.slots(a, b)
    assert hashed.size == 20_000 and np.array_equal(np.sort(slots), np.arange(20_000))
    table = np.empty((20_000, 2), np.uint64)
    table[slots] = np.stack([a, b], axis=1)
    asked = hashed.slots(a + np.uint64(1), b)
    held = np.maximum(asked, 0)
    assert not ((table[held, 0] == a + np.uint64(1)) & (table[held, 1] == b)).any()
    with pytest.raises(ValueError):
        trie.PerfectHash(np.append(a, a[0]), np.append(b, b[0]))
