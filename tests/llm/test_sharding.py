"""Sharding against the published loop, and its edge cases."""

import struct
import zlib

import xxhash

from pflegetakt.llm import sharding
from pflegetakt.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def bits(value):
    return xxhash.xxh64_intdigest(struct.pack("<q", value), seed=42)


def test_shards_follow_the_loop(spark):
    ids = [*range(500), -1, 2**62, -(2**63)]
    frame = spark.createDataFrame([(i,) for i in ids], "k long")
    for shards in (1, 2, 16, 97):
        rows = sharding.assign_shards(frame, ["k"], shards, "s", "g").collect()
        for r in rows:
            assert r["s"] == jump(bits(r["k"]), shards)
            assert r["g"] in (r["s"], shards)


def test_null_repeated_and_clashing(spark):
    frame = spark.createDataFrame([(None, "x", 7), (None, "y", 7), (3, "z", 7), (3, "z", 7)], "k long, shard string, other int")
    rows = sharding.assign_shards(frame, ["k"], 8).collect()
    assert len(rows) == 4 and len({r["shard"] for r in rows if r["k"] is None}) == 1
    assert all(r["shard"] == jump(bits(3), 8) for r in rows if r["k"] == 3)
    assert sharding.assign_shards(frame.limit(0), ["k"], 8).count() == 0


def test_slots_have_no_gaps_for_any_rows(spark):
    rows = [(i % 7 if i % 3 else None, zlib.crc32(str(i % 11).encode())) for i in range(600)]
    frame = sharding.assign_shards(spark.createDataFrame(rows, "k long, c long"), ["k"], 4)
    got = sharding.number_within_shards(frame, ["k"], "c", "shard", "slot").collect()
    assert sorted((r["k"], r["c"]) for r in got if r["k"] is not None) == sorted(r for r in rows if r[0] is not None)
    for shard in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.number_within_shards(frame.limit(0), ["k"], "c", "shard", "slot").count() == 0


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op3_sharding"](spark, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r["shard"], r["grown_shard"]) == (jump(bits(r["doc_id"]), 16), jump(bits(r["doc_id"]), 17))
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_plan_has_no_shuffle_for_shards(spark):
    plan = sharding.assign_shards(spark.range(10), ["id"], 16)._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1]
