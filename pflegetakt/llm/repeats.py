"""Removal of bytes that repeat: suffix order of shards, merged through their Burrows-Wheeler transforms.

A byte goes if it lies in a string of `width` bytes that also starts earlier, in a lesser document or
before it in the same one. Texts are UTF-8 bytes; strings never cross documents.

1. Anchors. Of the grams of `GRAM` bytes in a string, the one of least hash is its anchor (the first of
   equals), so equal strings have equal anchors at equal places. Neighbouring strings mostly share
   theirs; such a run of strings is a segment, some 140 bytes long.
2. Only segments whose anchor occurs twice in the corpus can hold a repeat. A bit table of fixed
   largest size says which; beyond its size it lets more segments pass and drops none.
3. Equal segments meet in the task that reads them, and again in the bucket of their anchors: all
   but the earliest are marked at once, and only different ones go on.
4. A bucket's segments with one anchor but different text are dealt into shards. Each shard sorts its
   suffixes and keeps its Burrows-Wheeler transform. The transforms are merged by refining the
   interleave of the shards: each round orders it by one more character, by a stable sort of the
   symbols that stand before the suffixes; no suffix is compared or sorted again. Suffixes that
   part in round h have a common prefix of h - 1; those alone from then on are left out, and what is
   still one block after `width` rounds is a repeated interval.
5. Within an interval all starts but the earliest are marked. Marks of a document are united, and its
   text is cut.

Segments of an anchor that alone has more than `hot` of them are not gathered in a bucket: each of their
strings is grouped by its own bytes.

Null texts are empty. Null ids come first; rows of one id stand by a hash of their text, and rows
equal in id and text are one document, returned as often as it stands. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

GRAM = 32
SLICE = 1 << 20
HASH_BITS = 44
MOST_BITS = 29
TABLE_SLICES = 64
BUCKET_BYTES = 4 << 20
SHARDS = 8
MERGED_BYTES = 128 << 10
"""Whole anchors are merged together up to about this size, so that a merge stays in the processor's cache."""
HOT_SEGMENTS = 20_000
MOST_HOT = 100_000
GATHERED_BYTES = 64 << 20
"""A task compares its segments with one another up to this many bytes at a time."""

_MASK = np.uint64((1 << HASH_BITS) - 1)
KEYS = ["k0", "k1"]


# Anchors


def _gram_hashes(t: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place."""
    h = (t.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    step = 1
    while step < GRAM:
        h = (h[:-step] ^ (h[:-step] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + h[step:]
        step *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h


def _least_within(x: np.ndarray, n: int) -> np.ndarray:
    """Least of the n values from each place."""
    have = 1
    while 2 * have <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == n else np.minimum(x[: len(x) - (n - have)], x[n - have :])


def segments(t: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last string start of each segment of the pieces [start, end) of t, and its anchor's hash."""
    none = np.empty(0, np.int64)
    if len(t) < width:
        return none, none, none
    place = np.arange(len(t) - GRAM + 1, dtype=np.uint64)
    keyed = (_gram_hashes(t) & ~np.uint64(SLICE * 2 - 1)) | place
    least = _least_within(keyed, width - GRAM + 1)
    long = ends - starts >= width
    edge = np.zeros(len(least) + 1, np.int32)
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - width + 1, -1)
    inside = np.cumsum(edge[:-1]) > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (least[1:] != least[:-1])
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    hashed = (least[lo] >> np.uint64(64 - HASH_BITS)) * np.uint64(0x9E3779B97F4A7C15)
    return lo, hi, ((hashed ^ (hashed >> np.uint64(32))) & _MASK).astype(np.int64)


def _pieces(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Texts of a batch as byte arrays of bounded size with (document, offset, start, end) of each piece.

    A long text is dealt into pieces that overlap by width - 1 bytes, so that each string is in one.
    """
    text, docs, parts, size = batch.column("text"), [], [], 0
    if not pa.types.is_binary(text.type):
        text = text.cast(pa.binary())
    for row in range(len(text)):
        data = text[row].as_buffer()
        if data is None or data.size < width:
            continue
        whole = np.frombuffer(data, np.uint8)
        for offset in range(0, len(whole) - width + 1, SLICE // 2):
            part = whole[offset : offset + SLICE // 2 + width - 1]
            if size and size + len(part) > SLICE:
                yield np.concatenate(parts), docs
                docs, parts, size = [], [], 0
            docs.append((row, offset, size, size + len(part)))
            parts.append(part)
            size += len(part)
    if parts:
        yield np.concatenate(parts), docs


def _cut(batch: pa.RecordBatch, width: int):
    for t, docs in _pieces(batch, width):
        where = np.array(docs, np.int64).reshape(-1, 4)
        yield t, where, *segments(t, where[:, 2], where[:, 3], width)


def _anchor_counter(width: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors for *_, anchors in _cut(batch, width)]
            if found:
                anchors, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(np.minimum(n, 2))], ["anchor", "n"])

    return count


def _bit_table(docs: DataFrame, width: int) -> tuple[int, bytes]:
    """Bits of the anchors that occur twice, by the first bits of their hash; at most 2 ** MOST_BITS of them."""
    counts = docs.select("text").mapInArrow(_anchor_counter(width), "anchor long, n long")
    often = stored(counts.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "anchors")
    bits = min(MOST_BITS, max(16, (16 * often.count()).bit_length()))
    slices = TABLE_SLICES
    cells = (1 << bits) // slices

    def fill(rows: pa.Table) -> pa.Table:
        table = np.zeros(cells, np.uint8)
        table[rows.column("cell").to_numpy() % cells] = 1
        return pa.table({"slice": rows.column("slice")[:1], "packed": pa.array([np.packbits(table).tobytes()], pa.binary())})

    cell = F.shiftright("anchor", HASH_BITS - bits).alias("cell")
    distinct = often.select(cell).distinct().withColumn("slice", F.floor(F.col("cell") / cells))
    packed = {r["slice"]: bytes(r["packed"]) for r in distinct.groupBy("slice").applyInArrow(fill, "slice long, packed binary").collect()}
    return bits, b"".join(packed.get(i, bytes(cells // 8)) for i in range(slices))


# Equal segments

_FOUND = "anchor long, segment binary, k0 long, k1 long, first long, last long"


class _Marks:
    """Marked byte ranges [first, last) of documents; ranges that follow on one another are united."""

    def __init__(self):
        self.rows: list[list[int]] = []

    def add(self, k0: int, k1: int, first: int, last: int) -> None:
        before = self.rows[-1] if self.rows else None
        if before and before[0] == k0 and before[1] == k1 and before[2] <= first <= before[3]:
            before[3] = max(last, before[3])
        else:
            self.rows.append([k0, k1, first, last])


def _found(segs: dict, marks: _Marks) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "segment", "k0", "k1", "first", "last"]
    rows = [(anchor, seg, *at, None) for (anchor, seg), at in segs.items()] + [(None, None, *row) for row in marks.rows]
    for i in range(0, len(rows), 20_000):
        columns = list(zip(*rows[i : i + 20_000], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if name == "segment" else pa.int64()) for c, name in zip(columns, names, strict=True)], names)


def _segment_finder(width: int, bits: int, shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        segs, marks, size = {}, _Marks(), 0
        for batch in batches:
            k0, k1 = (batch.column(c).to_pylist() for c in KEYS)
            for t, where, lo, hi, anchors in _cut(batch, width):
                cell = anchors >> (HASH_BITS - bits)
                wanted = (table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
                lo, hi, anchors = lo[wanted], hi[wanted], anchors[wanted]
                piece = np.searchsorted(where[:, 2], lo, side="right") - 1
                shift = where[piece, 1] - where[piece, 2]
                data = t.tobytes()
                for row, first, last, move, anchor in zip(where[piece, 0].tolist(), lo.tolist(), (hi + width).tolist(), shift.tolist(), anchors.tolist(), strict=True):
                    key = (anchor, data[first:last])
                    here = (k0[row], k1[row], first + move)
                    there = segs.get(key)
                    if there is None:
                        segs[key] = here
                        size += last - first
                    elif there < here:
                        marks.add(*here, here[2] + last - first)
                    elif there > here:
                        marks.add(*there, there[2] + last - first)
                        segs[key] = here
            if size > GATHERED_BYTES:
                yield from _found(segs, marks)
                segs, marks, size = {}, _Marks(), 0
        yield from _found(segs, marks)

    return find


# Transforms of shards and their merge

END = 255  # no byte of UTF-8


def suffix_order(t: np.ndarray) -> np.ndarray:
    """Places of a shard's strings, each closed by END, in the order of their suffixes; equal ones by place."""
    n = len(t)
    ends = np.flatnonzero(t == END)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)  # characters to the end of the string
    wide = np.concatenate([t, np.full(8, END, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | np.where(left >= j, wide[j : j + n], np.uint8(END))
    step, longest, place = 8, int(left.max(initial=0)) + 1, np.arange(n)
    while True:
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        if step >= longest:
            return np.argsort(rank * n + place)
        # Equal ranks have equal distances to their ends, so none meets a neighbour's characters.
        key = rank * (n + 2) + np.where(left >= step, rank[np.minimum(place + step, n - 1)] + 1, 0)
        step *= 2


def transform(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Symbol before each suffix; END before a whole string."""
    return np.where(order == 0, np.uint8(END), t[order - 1])


def merged_intervals(shards: list[tuple[np.ndarray, np.ndarray]], kind: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Repeated intervals of `rounds` characters among the shards' suffixes.

    Takes places and transform of each shard, and for every place the kind of the string of `rounds`
    characters that ends there, or -1; only strings of one kind are compared. Round h orders the
    suffixes h characters before those ends by their first h characters: a stable sort of the symbols
    that stand before, then one step to the left in each shard's own order. A suffix that is alone in
    its block has no equal and is left out from then on. Returns the places that are left, interval
    by interval, and the number of their interval.
    """
    places = np.concatenate([order for order, _ in shards])
    symbols = np.concatenate([before for _, before in shards])
    steps, base = [], 0
    for order, before in shards:
        step = np.empty(len(order), np.int32)
        step[np.argsort(before, kind="stable")] = np.arange(base, base + len(order), dtype=np.int32)
        steps.append(step)
        base += len(order)
    left = np.concatenate(steps)  # where the suffix one character longer stands in the order of its shard
    kinds = kind[places]
    slot = np.flatnonzero(kinds >= 0).astype(np.int32)
    slot = slot[np.argsort(kinds[slot], kind="stable")]
    block = kinds[slot]
    for h in range(1, rounds + 1):
        before = symbols[slot]
        order = np.argsort(before, kind="stable")
        moved, before = block[order], before[order]
        begins = np.ones(len(slot) + 1, bool)
        begins[1:-1] = (moved[1:] != moved[:-1]) | (before[1:] != before[:-1])
        slot = left[slot[order]]
        if h % 8 == 0 or h == 4 or h == rounds:
            several = ~(begins[:-1] & begins[1:])
            slot, begins = slot[several], begins[:-1][several]
        else:
            begins = begins[:-1]
        block = np.cumsum(begins, dtype=np.int32)
    return places[slot], block


def repeated(texts: list[bytes], kinds: list[int], width: int, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every string of `width` bytes that also starts in an earlier text of its kind.

    No text may hold one string twice. Texts of a kind are dealt over the shards in turn, because a
    shard without repeats is sorted in few rounds.
    """
    if not texts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    dealt: list[list[int]] = [[] for _ in range(shards)]
    turn: dict[int, int] = {}
    for i, kind in enumerate(kinds):
        turn[kind] = at = turn.get(kind, kind) + 1
        dealt[at % shards].append(i)
    sorted_shards, base = [], 0
    for members in filter(None, dealt):
        t = np.frombuffer(b"\xff".join([*[texts[i] for i in members], b""]), np.uint8)
        order = suffix_order(t)
        sorted_shards.append((order + base, transform(t, order)))
        base += len(t)
    text = np.concatenate([np.array(members, np.int64) for members in dealt])
    lengths = np.array([len(x) for x in texts])[text]
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    kind = np.repeat(np.unique(np.array(kinds), return_inverse=True)[1][text].astype(np.int32), lengths + 1)
    for i in range(width):
        kind[starts + np.minimum(i, lengths)] = -1
    place, block = merged_intervals(sorted_shards, kind, width)
    at = np.searchsorted(starts, place, side="right") - 1
    row, at = text[at], place - starts[at]
    if not len(row):
        return row, at
    heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    earliest = np.repeat(np.minimum.reduceat(row, heads), np.diff(np.append(heads, len(row))))
    return row[row > earliest], at[row > earliest]


def _mark_repeated(found: list[tuple[tuple[int, int, int], bytes, int]], width: int, marks: _Marks) -> None:
    found.sort()
    row, at = repeated([seg for _, seg, _ in found], [anchor for *_, anchor in found], width)
    order = np.lexsort((at, row))
    for r, p in zip(row[order].tolist(), at[order].tolist(), strict=True):
        (k0, k1, first), *_ = found[r]
        marks.add(k0, k1, first + p, first + p + width)


def _bucket_merger(width: int):
    def merge(bucket: pa.Table) -> pa.Table:
        rows = sorted(zip(*[bucket.column(c).to_pylist() for c in ("k0", "k1", "first", "anchor", "segment")], strict=True))
        marks, seen, by_anchor = _Marks(), {}, {}
        for k0, k1, first, anchor, seg in rows:
            here = (k0, k1, first)
            there = seen.setdefault((anchor, seg), here)
            if there is here:
                by_anchor.setdefault(anchor, []).append((here, seg, anchor))
            elif there != here:
                marks.add(*here, first + len(seg))
        several, size = [], 0
        for group in by_anchor.values():
            if len(group) > 1:
                several += group
                size += sum(len(seg) for _, seg, _ in group)
                if size > MERGED_BYTES:
                    _mark_repeated(several, width, marks)
                    several, size = [], 0
        _mark_repeated(several, width, marks)
        columns = list(zip(*marks.rows, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=[*KEYS, "first", "last"])

    return merge


def _hot_marks(hot: DataFrame, width: int) -> DataFrame:
    """Marks among the strings of anchors with very many segments, grouped by their own bytes."""
    strings = hot.withColumn("at", F.explode(F.sequence(F.lit(0), F.octet_length("segment") - width)))
    strings = strings.select(F.expr(f"substring(segment, at + 1, {width})").alias("string"), *KEYS, (F.col("first") + F.col("at")).alias("first"))
    earliest = strings.groupBy("string").agg(F.min(F.struct(*KEYS, "first")).alias("earliest"))
    rest = strings.join(earliest, "string").where(F.struct(*KEYS, "first") > F.col("earliest"))
    return rest.select(*KEYS, "first", (F.col("first") + width).alias("last"))


# Documents


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """`k0 k1 doc_id text`: keys in the order of documents; null texts empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    k0 = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    return docs.select(k0.alias("k0"), F.xxhash64(body, F.col(doc_id).isNull()).alias("k1"), F.col(doc_id).alias("doc_id"), body.alias("text"))


def repeat_marks(docs: DataFrame, width: int, hot: int = HOT_SEGMENTS) -> DataFrame:
    """`k0 k1 first last`: byte ranges of `keyed` documents that repeat; they may overlap."""
    spark = docs.sparkSession
    bits, table = _bit_table(docs, width)
    shared = spark.sparkContext.broadcast(table)  # at most 2 ** MOST_BITS bits
    found = stored(docs.select(*KEYS, "text").mapInArrow(_segment_finder(width, bits, shared), _FOUND), "segments")
    segs = found.where("segment IS NOT NULL").select("anchor", "segment", *KEYS, "first")
    marks = found.where("segment IS NULL").select(*KEYS, "first", "last")
    rows, size = segs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("segment")), F.lit(0))).first()
    hot_anchors = stored(segs.groupBy("anchor").count().where(F.col("count") > max(hot, rows // MOST_HOT)).select("anchor"), "hot")
    few = F.broadcast(hot_anchors)  # at most MOST_HOT rows
    buckets = segs.join(few, "anchor", "left_anti").withColumn("bucket", F.pmod("anchor", F.lit(size // BUCKET_BYTES + 1)))
    merged = buckets.groupBy("bucket").applyInArrow(_bucket_merger(width), "k0 long, k1 long, first long, last long")
    return marks.unionByName(stored(merged, "marks")).unionByName(_hot_marks(segs.join(few, "anchor", "left_semi"), width))


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        rows = []
        for doc_id, text, marks in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "marks")], strict=True):
            data, kept, at, removed, spans, edge = text.encode(), hashlib.sha256(), 0, 0, 0, -1
            for mark in marks or ():
                first, last = mark["first"], mark["last"]
                spans += first > edge
                edge = max(edge, last)
                if last > at:
                    kept.update(data[at : max(at, first)])
                    removed += last - max(at, first)
                    at = last
            kept.update(data[at:])
            rows.append((doc_id, len(data), removed, spans, kept.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if name == "kept_sha256" else pa.int64()) for c, name in zip(zip(*rows, strict=True), names, strict=True)] if rows else [pa.array([], pa.string() if name == "kept_sha256" else pa.int64()) for name in names], names)


def cut_repeats(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """`doc_id n_bytes n_removed n_spans kept_sha256` of every `keyed` document less its marked bytes."""
    by_doc = marks.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("marks"))
    joined = docs.join(by_doc, KEYS, "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(_cutter, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
