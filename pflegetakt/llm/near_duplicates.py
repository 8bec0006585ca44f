"""SimHash near-duplicates: self-join of a binary trie of fingerprints by traversing node pairs.

Starting from pairs of upper nodes, both nodes of a pair are split by their next bit together;
a pair's children whose bits differ use up error budget, and a pair over budget is pruned with
all below it. Two bit orders are traversed, so that the upper half of the trie can work with a
smaller budget: fingerprints that differ in at most b bits differ in at most b // 2 of the
first 32, or in at most b - b // 2 - 1 of the last 32.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import small_side, stored
from .components import components

SEED = 42
HALF = 32
LEAF_PAIRS = 64
FRONTIER = 1 << 17


def simhash(text: bytes | None, shingle: int) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a UTF-8 text, repeats included.

    A-Z are lower-cased; words are runs without ASCII blanks. Fewer words than `shingle` make
    one shingle; no words (null, empty, blanks) give 0.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    digest, n = xxhash.xxh64_intdigest, len(starts)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        part = zip(starts[at : at + (1 << 14)], stops[at : at + (1 << 14)], strict=True)
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in part), np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def simhashes(df: DataFrame, keep: list[str], text_col: str, shingle: int) -> DataFrame:
    """(kept columns, fingerprint): the SimHash of every row's whole text as a signed long."""
    own = df.select(*keep, F.col(text_col).cast("binary").alias("_text"))
    kept = [f for f in own.schema.fields if f.name != "_text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(t.as_py(), shingle) for t in batch.column(batch.num_columns - 1)]
            signed = pa.array(np.asarray(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], signed], [*batch.schema.names[:-1], "fingerprint"])

    return own.mapInArrow(work, StructType([*kept, StructField("fingerprint", LongType())]))


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[i], lo[i] + 1, ... of n[i] numbers each, one after the other."""
    return np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def traverse(a: np.ndarray, b: np.ndarray, upper: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into a, into b) of keys at most `budget` bits apart, `upper` of them in the first half.

    a and b are sorted distinct uint64 keys in trie order; where they are one array, each pair
    comes once. Nodes are ranges of the sorted keys. Small node pairs are compared directly. The
    frontier is worked off from a stack in bounded pieces, deepest first.
    """
    same = a is b
    if not len(a) or not len(b):
        return
    one = np.uint64(1)
    stack = [(0, *(np.asarray([x], np.int64) for x in (0, len(a), 0, len(b), 0)))]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > FRONTIER:
            cut = len(alo) // 2
            stack += [(depth, *(x[s] for x in (alo, ahi, blo, bhi, err))) for s in (slice(0, cut), slice(cut, None))]
            continue
        small = (ahi - alo) * (bhi - blo) <= LEAF_PAIRS
        small |= depth == 64
        if small.any():
            for at in range(0, len(alo), 1 << 14):
                s = np.flatnonzero(small[at : at + (1 << 14)]) + at
                na, nb = ahi[s] - alo[s], bhi[s] - blo[s]
                i = np.repeat(_ranges(alo[s], na), np.repeat(nb, na))
                j = _ranges(np.repeat(blo[s], na), np.repeat(nb, na))
                apart = a[i] ^ b[j]
                ok = (np.bitwise_count(apart) <= budget) & (np.bitwise_count(apart >> np.uint64(HALF)) <= upper)
                if same:
                    ok &= i < j
                yield i[ok], j[ok]
        go = ~small
        if not go.any():
            continue
        alo, ahi, blo, bhi, err = (x[go] for x in (alo, ahi, blo, bhi, err))
        bit = one << np.uint64(63 - depth)
        clear = ~((bit << one) - one) if depth else np.uint64(0)
        amid = np.clip(np.searchsorted(a, (a[alo] & clear) | bit), alo, ahi)
        bmid = np.clip(np.searchsorted(b, (b[blo] & clear) | bit), blo, bhi)
        allowed = upper if depth < HALF else budget
        twin = (alo == blo) & (ahi == bhi) if same else np.zeros(len(alo), bool)
        parts = []
        for left, right in ((0, 0), (1, 1), (0, 1), (1, 0)):
            x = ((alo, amid) if not left else (amid, ahi)) + ((blo, bmid) if not right else (bmid, bhi))
            e = err + (left != right)
            ok = (x[0] < x[1]) & (x[2] < x[3]) & (e <= allowed)
            if (left, right) == (1, 0):
                ok &= ~twin
            parts.append([y[ok] for y in (*x, e)])
        joined = [np.concatenate(p) for p in zip(*parts, strict=True)]
        if len(joined[0]):
            stack.append((depth + 1, *joined))


def join_labels(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Unites the sets of u[i] and v[i] in place; a set's label is its least member."""
    while len(u):
        ru, rv = labels[u], labels[v]
        apart = ru != rv
        u, v = u[apart], v[apart]
        np.minimum.at(labels, np.maximum(ru, rv)[apart], np.minimum(ru, rv)[apart])
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def _swapped(x: np.ndarray) -> np.ndarray:
    return (x << np.uint64(HALF)) | (x >> np.uint64(HALF))


def _forest(left: np.ndarray, right: np.ndarray | None, upper: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the node pair's traversal connects: fewer than it has keys.

    Without a right side the node is joined with itself.
    """
    one_node = right is None
    a = np.sort(left)
    b = a if one_node else np.sort(right)
    labels = np.arange(len(a) + (0 if one_node else len(b)))
    for i, j in traverse(a, b, upper, budget):
        join_labels(labels, i, j if one_node else j + len(a))
    keys = a if one_node else np.concatenate([a, b])
    tied = np.flatnonzero(labels != np.arange(len(labels)))
    return keys[labels[tied]], keys[tied]


def near_links(fingerprints: DataFrame, budget: int, node_keys: int = 1 << 15) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints at most `budget` bits apart.

    The upper trie is cut at a depth that follows from the number of fingerprints, so that a
    mean node has `node_keys` of them; nodes with more, such as those of a large group of near
    copies, are dealt into slices, and pairs of slices are joined. So no task holds more than
    about two times `node_keys` fingerprints. Each task traverses one pair of nodes and returns
    a spanning forest of the links it found, never all pairs. Distinct fingerprints only are
    compared; the driver receives counts of upper nodes (at most 2^14) only.
    """
    distinct = stored(fingerprints.select("fingerprint").where("fingerprint is not null").distinct(), "fingerprints")
    total = distinct.count()
    depth = min(14, max(3, int(np.ceil(np.log2(max(total, 1) / node_keys)))))
    orders = [(0, budget // 2), (1, budget - budget // 2 - 1)]
    heavy = []
    for order, _ in orders:
        shift = 64 - depth if not order else HALF - depth
        node = F.shiftrightunsigned("fingerprint", shift).bitwiseAND(F.lit((1 << depth) - 1))
        counts = distinct.groupBy(node.alias("node")).agg(F.count("*").alias("n"))
        heavy.append({r["node"]: -(-r["n"] // node_keys) for r in counts.where(F.col("n") > node_keys).collect()})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = np.arange(1 << depth, dtype=np.int64)
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for order, upper in orders:
                if upper < 0:
                    continue
                key = _swapped(x) if order else x
                node = (key >> np.uint64(64 - depth)).astype(np.int64)
                slices = np.ones(1 << depth, np.int64)
                for k, n in heavy[order].items():
                    slices[k] = n
                own = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % slices[node]
                for flip in nodes[np.bitwise_count(nodes) <= upper].tolist():
                    other = node ^ flip
                    for at in range(int(slices[other].max(initial=0))):
                        there = slices[other] > at
                        yield from _dealt(order, node[there], own[there], other[there], at, key[there])

    def _dealt(order, node, own, other, at, key) -> Iterator[pa.RecordBatch]:
        left = (node < other) | ((node == other) & (own <= at))
        lo, hi = np.where(left, node, other), np.where(left, other, node)
        i, j = np.where(left, own, at), np.where(left, at, own)
        columns = [np.full(len(key), order, np.int64), lo, hi, i, j, left.astype(np.int64), key.view(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["o", "lo", "hi", "i", "j", "side", "key"])

    def match(group: pa.Table) -> pa.Table:
        order = group.column("o")[0].as_py()
        key = group.column("key").to_numpy().view(np.uint64)
        side = group.column("side").to_numpy().astype(bool)
        alone = all(group.column(x)[0] == group.column(y)[0] for x, y in (("lo", "hi"), ("i", "j")))
        a, b = _forest(key[side], None if alone else key[~side], orders[order][1], budget)
        a, b = (_swapped(a), _swapped(b)) if order else (a, b)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.mapInArrow(deal, "o long, lo long, hi long, i long, j long, side long, key long")
    return dealt.groupBy("o", "lo", "hi", "i", "j").applyInArrow(match, "a long, b long")


def fingerprint_components(rows: DataFrame, id_col: str, budget: int) -> DataFrame:
    """(fingerprint, component_id): least id among all documents reachable over near fingerprints.

    `rows` (id, fingerprint) should be stored, as it is read more than once. Null ids never are
    the least, unless a component has no other.
    """
    roots = components(near_links(rows, budget))
    least = stored(rows.groupBy("fingerprint").agg(F.min(id_col).alias("least")), "least")
    rooted = least.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    rooted = stored(rooted.withColumn("root", F.coalesce("root", "fingerprint")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fingerprint", "component_id")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, shingle: int = 4, budget: int = 4) -> DataFrame:
    """(id, text_key, fingerprint, component_id) of every row; text_key stands for the text.

    Fingerprints link at `budget` or fewer differing bits, whole chains form a component.
    Null, empty and blank texts have fingerprint 0 and link like others; repeated rows come back
    as often as they are; further columns are not read.
    """
    rows = simhashes(df.select(id_col, text_col, F.xxhash64(text_col).alias("text_key")), [id_col, "text_key"], text_col, shingle)
    rows = stored(rows, "simhash")
    found = stored(fingerprint_components(rows, id_col, budget), "near")
    return rows.join(small_side(found), "fingerprint").select(id_col, "text_key", "fingerprint", "component_id")


def keep_one_each(df: DataFrame, id_col: str, text_col: str, shingle: int = 4, budget: int = 4) -> DataFrame:
    """One row of every component of near-duplicates: that of the least id, with all its columns.

    Rows without an id stay only where a component has none with an id. Of rows equal in id one
    stays, the one with the least text hash.
    """
    found = near_duplicates(df, id_col, text_col, shingle, budget)
    own = F.when(F.col(id_col).isNull() & F.col("component_id").isNull() | (F.col(id_col) == F.col("component_id")), F.col("text_key"))
    unnamed = F.when(F.col("component_id").isNull(), F.col("fingerprint"))
    kept = found.where(own.isNotNull()).withColumn("_f", unnamed).groupBy(id_col, "component_id", "_f").agg(F.min("text_key").alias("_key"))
    # keys that are never null, so that join and de-duplication share one shuffle of the texts
    named = F.coalesce(F.col(id_col).cast("string"), F.lit("\0"))
    kept = stored(kept.select(named.alias("_near_id"), F.col("_key").alias("_near_text")), "kept")
    keyed = df.withColumns({"_near_id": named, "_near_text": F.coalesce(F.xxhash64(text_col), F.lit(0))})
    chosen = keyed.join(kept.hint("merge"), ["_near_id", "_near_text"], "left_semi")
    return chosen.dropDuplicates(["_near_id", "_near_text"]).select(*df.columns)
