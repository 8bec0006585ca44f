"""Repeated bytes against brute force; merged transforms against sorting."""

import hashlib
import random

import numpy as np
import pytest

from oracle import compare, connect
from pflegetakt.llm import repeats
from pflegetakt.llm.queries import ORACLE, QUERIES


def brute(rows, width):
    """(doc_id, n_bytes, n_removed, n_spans, hash) of distinct ids in order; null ids first."""
    out, seen = [], set()
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - width + 1):
            if data[p : p + width] in seen:
                gone[p : p + width] = True
            seen.add(data[p : p + width])
        gone[-1] = False
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def cut(spark, rows, width, **options):
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, k0 string, marks string")
    docs = repeats.keyed(frame.repartition(5), "doc_id", "text")
    found = repeats.cut_repeats(docs, repeats.repeat_marks(docs, width, **options)).collect()
    return sorted((tuple(r) for r in found), key=repr)


def some_rows(seed, letters="ab cdé"):
    rnd = random.Random(seed)
    new = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    passages = [new(n) for n in (90, 100, 130, 400)]
    rows = [(None, passages[2]), (5, None), (6, ""), (7, "x" * 3000), (8, "ab" * 700 + passages[1])]
    for i in range(10, 90):
        parts = [new(rnd.randint(0, 150))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            parts += [p if rnd.random() < 0.7 else p[:60] + new(1) + p[60:], new(rnd.randint(0, 90))]
        rows.append((i, "".join(parts)))
    rows += [(200 + i, rows[20][1]) for i in range(30)]  # exact copies
    return rows


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert compare(QUERIES["op13_suffix_array_dedup"](spark, sf_dir), connect(sf_dir), ORACLE["op13_suffix_array_dedup"]) == ""


@pytest.mark.parametrize("hot", [20_000, 3])
def test_equals_brute_force(spark, hot):
    rows = some_rows(5)
    assert cut(spark, rows, 100, hot=hot) == brute(rows, 100)


def test_rows_of_one_id(spark):
    rows = [(1, "p" * 50 + "q" * 70), (1, "p" * 50 + "q" * 70), (2, "p" * 50 + "q" * 70)]
    got = cut(spark, rows, 100)
    assert [r[2] for r in got] == [0, 0, 120]  # the repeated row is the same document, the other id is later
    assert cut(spark, [], 100) == []


def test_long_texts_are_dealt_into_overlapping_pieces(spark):
    rnd = random.Random(1)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(3 * repeats.SLICE // 2 + 77))
    at = repeats.SLICE // 2 - 40
    rows = [(1, long), (2, "new " + long[at : at + 150] + " new"), (3, long[:99])]
    assert cut(spark, rows, 100) == brute(rows, 100)


def strings(texts):
    return np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)


def test_suffixes_of_a_shard_are_in_order():
    rnd = random.Random(2)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 60))) for _ in range(40)] + [b"a" * 50, b"a" * 50]
    t = strings(texts)
    ends = [i for i, x in enumerate(t) if x == repeats.END]
    wanted = sorted(range(len(t)), key=lambda p: (bytes(t[p : next(e for e in ends if e >= p) + 1]), p))
    assert repeats.suffix_order(t).tolist() == wanted


@pytest.mark.parametrize("shards", [1, 2, 8])
def test_merged_intervals_equal_grouping(shards):
    rnd = random.Random(3)
    cores = [bytes(rnd.choice(b"abc") for _ in range(40)) for _ in range(4)]
    texts, kinds = [], []
    for i in range(60):
        kinds.append(i % 4)
        texts.append(bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 12))) + cores[i % 4][: rnd.randint(10, 40)] + b"%d" % i)
    row, at = repeats.repeated(texts, kinds, 20, shards)
    seen, wanted = set(), set()
    for i, (text, kind) in enumerate(zip(texts, kinds, strict=True)):
        for p in range(len(text) - 19):
            key = (kind, text[p : p + 20])
            if key in seen:
                wanted.add((i, p))
            seen.add(key)
    assert set(zip(row.tolist(), at.tolist(), strict=True)) == wanted and len(row) == len(wanted)
