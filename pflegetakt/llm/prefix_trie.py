"""Trie of conversation prefixes in minimal-perfect-hash node tables.

A node is a distinct sequence of first turns. Its digest is a sum over its turns of a hash of the
place and the turn's SHA-256, in two lanes of 62 bits; a sum can be taken in pieces, so a
conversation that holds a third of all turns is numbered and summed in many tasks.

1. `numbered_turns`: turns in order, counted within range pieces.
2. `prefix_nodes`: distinct prefix digests with their members, combined before the shuffle.
3. Heavy nodes (more than `heavy` members) form the top of the trie; there are at most rows / heavy
   of them. What hangs below a heavy node, and every `LAYER` turns of a deep conversation, starts a
   subtree of its own. Whole subtrees are dealt into shards.
4. A shard is one task. It gives every digest a slot by a minimal perfect hash, checks that each slot
   holds the digest that was asked for, scatters counts into flat arrays, and adds them up through
   the array of parent slots, from the deepest level. Subtrees hand their sums to the shard or top
   above.

Rows without conversation id belong to no conversation and are left out. Null role and text are
empty, null turns come first, rows of one turn number stand by the SHA-256 of role and text;
repeated rows are turns like any other. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LANE = 1 << 62
LAYER = 1024
HEAVY_MEMBERS = 5_000
TOP_ROWS = 200_000
SHARD_ROWS = 200_000

WORDS = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = ["depth", "p1", "p2"]


def numbered_turns(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """`conv_id pos n digest words`: place of each turn from 1, and the turns of its conversation."""
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    narrow = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256)).alias("digest"),
        F.regexp_count(said, F.lit(WORDS)).cast("long").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("digest").asc()]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = stored(narrow.repartitionByRange(parts, F.col("conv_id").asc(), *order).withColumn("piece", F.spark_partition_id()), "turns")
    sizes = pieces.groupBy("conv_id", "piece").agg(F.count("*").alias("rows"))
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sizes.select("conv_id", "piece", (F.sum("rows").over(before) - F.col("rows")).alias("start"), F.sum("rows").over(whole).alias("n"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "piece").orderBy(*order))
    numbered = pieces.withColumn("inside", inside).join(starts, ["conv_id", "piece"])
    return numbered.select("conv_id", (F.col("start") + F.col("inside")).alias("pos"), "n", "digest", "words")


def regrafted(numbered: DataFrame, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of the group's first conversation.

    h is crc32 of the decimal id, modulo `most` + 1; the group's first id is a multiple of `group`.
    Returns `conv_id depth total digest words` and the members `conv_id total`, turnless ones too.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    sizes = numbered.where("pos = 1").select("conv_id", "n")
    members = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    bases = sizes.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least(F.col("h"), F.coalesce("base_n", F.lit(0)))
    members = members.join(bases, "base", "left").withColumn("taken", taken)
    members = stored(members.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "members")
    own = numbered.withColumn("h", h).where("pos > h").drop("h").join(members, "conv_id")
    own = own.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "total", "digest", "words")
    heads = numbered.where((F.col("conv_id") % group == 0) & (F.col("pos") <= most)).select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    lent = members.join(heads, "base").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "total", "digest", "words")
    return own.unionByName(lent), members.select("conv_id", "total")


def prefix_rows(turns: DataFrame, layer: int = LAYER) -> DataFrame:
    """Every prefix of every conversation: its digest `p1 p2`, its parent's `q1 q2`, its last turn's words."""
    lanes = [F.xxhash64("depth", "digest", F.lit(k)).cast("decimal(20,0)") for k in (1, 2)]
    rows = turns.select("*", (F.floor((F.col("depth") - 1) / layer)).alias("layer"), lanes[0].alias("a1"), lanes[1].alias("a2"))
    sums = rows.groupBy("conv_id", "layer").agg(F.sum("a1").alias("s1"), F.sum("a2").alias("s2"))
    earlier = Window.partitionBy("conv_id").orderBy("layer").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carries = sums.select("conv_id", "layer", *[(F.sum(f"s{k}").over(earlier) - F.col(f"s{k}")).alias(f"c{k}") for k in (1, 2)])
    running = Window.partitionBy("conv_id", "layer").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"r{k}": F.sum(f"a{k}").over(running) for k in (1, 2)}).join(carries, ["conv_id", "layer"])

    def lane(total: Column) -> Column:
        return F.pmod(total, F.lit(LANE).cast("decimal(38,0)")).cast("long")

    own = [lane(F.col(f"r{k}") + F.col(f"c{k}")).alias(f"p{k}") for k in (1, 2)]
    parents = [lane(F.col(f"r{k}") + F.col(f"c{k}") - F.col(f"a{k}")).alias(f"q{k}") for k in (1, 2)]
    return rows.select("conv_id", "depth", "total", "layer", *own, *parents, "words")


def prefix_nodes(prefixes: DataFrame, heavy: int, layer: int = LAYER) -> DataFrame:
    """One row a node: `depth p1 p2 q1 q2 layer conv_id n_convs words is_heavy starts root1 root2`.

    `starts` marks the first node of a subtree, `root1 root2` name the subtree of a node that is not heavy.
    """
    often = stored(prefixes.groupBy(*NODE).agg(F.count("*").alias("n")).where(F.col("n") > heavy).select(*NODE), "heavy")
    own = F.broadcast(often.withColumn("is_heavy", F.lit(True)))  # at most rows / heavy, which the caller bounds
    above = F.broadcast(often.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.lit(True).alias("below_heavy")))
    rows = prefixes.join(own, NODE, "left").join(above, ["depth", "q1", "q2"], "left")
    rows = rows.withColumns({"is_heavy": F.coalesce("is_heavy", F.lit(False)), "below_heavy": F.coalesce("below_heavy", F.col("depth") == 1)})
    starts = ~F.col("is_heavy") & (F.col("below_heavy") | ((F.col("depth") - 1) % layer == 0))
    rows = rows.withColumn("starts", starts)
    running = Window.partitionBy("conv_id", "layer").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in (1, 2):
        rows = rows.withColumn(f"root{k}", F.last(F.when(F.col("starts"), F.col(f"p{k}")), ignorenulls=True).over(running))
    same = ["q1", "q2", "layer", "words", "is_heavy", "below_heavy", "starts", "root1", "root2"]
    return rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.max(c).alias(c) for c in same])


# Node tables


def _mixed(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    x = a ^ (b * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((seed * 0xD1342543DE82EF95) % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Slots 0 to n-1 for n distinct keys of two 64-bit lanes; no keys are kept.

    Keys that are alone in a cell of a level's bit table get the rank of that cell; the others go to
    the next level.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, placed = np.arange(len(a)), 0
        while len(left):
            if len(self.levels) > 64:
                raise ValueError("keys repeat")
            cells = max(64, int(1.5 * len(left)))
            at = (_mixed(a[left], b[left], len(self.levels)) % np.uint64(cells)).astype(np.int64)
            alone = np.bincount(at, minlength=cells) == 1
            self.levels.append((alone, np.cumsum(alone) + (placed - 1)))
            placed += int(alone.sum())
            left = left[~alone[at]]
        self.size = placed

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A slot for every key; for unknown keys any slot, or -1. The caller checks what it holds."""
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (alone, rank) in enumerate(self.levels):
            at = (_mixed(a[left], b[left], level) % np.uint64(len(alone))).astype(np.int64)
            here = alone[at]
            out[left[here]] = rank[at[here]]
            left = left[~here]
        return out


def add_up(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sums of a shard's nodes over their subtrees, through parent slots, from the deepest level.

    Takes `depth p1 p2 q1 q2 conv_id n_convs words` and what subtrees below hand up, `in_children
    in_leaves in_saved`. Returns the node keys with `parent_conv_id known n_children n_leaves saved_tokens`.
    """
    depth = columns["depth"]
    lanes = {c: columns[c].astype(np.uint64) for c in ("p1", "p2", "q1", "q2")}
    level = depth.astype(np.uint64) << np.uint64(32)
    hashed = PerfectHash(lanes["p1"] ^ level, lanes["p2"])
    slot = hashed.slots(lanes["p1"] ^ level, lanes["p2"])
    table = {c: np.empty(hashed.size, np.int64) for c in columns}
    for c, values in columns.items():
        table[c][slot] = values
    up = hashed.slots(table["q1"].astype(np.uint64) ^ ((table["depth"] - 1).astype(np.uint64) << np.uint64(32)), table["q2"].astype(np.uint64))
    held = np.maximum(up, 0)
    known = (up >= 0) & (table["depth"][held] == table["depth"] - 1) & (table["p1"][held] == table["q1"]) & (table["p2"][held] == table["q2"])
    children = table["in_children"] + np.bincount(held[known], minlength=hashed.size)
    leaves = table["in_leaves"] + (children == 0)
    saved = table["in_saved"] + (table["n_convs"] - 1) * table["words"]
    order = np.argsort(-table["depth"], kind="stable")
    cuts = np.flatnonzero(np.diff(table["depth"][order])) + 1
    for nodes in np.split(order, cuts):
        below = nodes[known[nodes]]
        np.add.at(leaves, held[below], leaves[below])
        np.add.at(saved, held[below], saved[below])
    out = {c: table[c] for c in NODE}
    return out | {"parent_conv_id": table["conv_id"][held], "known": known, "n_children": children, "n_leaves": leaves, "saved_tokens": saved}


_SUMS = "depth long, p1 long, p2 long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"
_TAKEN = [*NODE, "q1", "q2", "conv_id", "n_convs", "words", "in_children", "in_leaves", "in_saved"]


def _settle(shard: pa.Table) -> pa.Table:
    done = add_up({c: shard.column(c).to_numpy().astype(np.int64, copy=False) for c in _TAKEN})
    known = done.pop("known")
    parent = pa.array(done.pop("parent_conv_id"), pa.int64(), mask=~known)
    arrays = [*[pa.array(done[c]) for c in NODE], parent, *[pa.array(done[c]) for c in ("n_children", "n_leaves", "saved_tokens")]]
    return pa.table(arrays, ["depth", "p1", "p2", "parent_conv_id", "n_children", "n_leaves", "saved_tokens"])


def _handed_up(nodes: DataFrame, sums: DataFrame) -> DataFrame:
    """What the first nodes of subtrees give to the nodes above them."""
    ends = nodes.select(*NODE, "q1", "q2").join(sums.select(*NODE, "n_leaves", "saved_tokens"), NODE)
    above = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    return ends.groupBy(*above).agg(F.count("*").alias("in_children"), F.sum("n_leaves").alias("in_leaves"), F.sum("saved_tokens").alias("in_saved"))


def _with_handed(nodes: DataFrame, handed: DataFrame | None) -> DataFrame:
    names = ["in_children", "in_leaves", "in_saved"]
    if handed is None:
        return nodes.withColumns(dict.fromkeys(names, F.lit(0).cast("long")))
    return nodes.join(handed, NODE, "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in names})


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids at each node, which come in order; only the running hash is kept."""
    key, digest = None, None
    names = ["depth", "p1", "p2", "ends_sha256"]
    for batch in batches:
        rows = []
        for *node, member in zip(*[batch.column(c).to_pylist() for c in (*NODE, "conv_id")], strict=True):
            if node != key:
                if key is not None:
                    rows.append((*key, digest.hexdigest()))
                key, digest = node, hashlib.sha256(str(member).encode())
            else:
                digest.update(f",{member}".encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, digest.hexdigest())], names)


def prefix_trie(turns: DataFrame, members: DataFrame, heavy: int = HEAVY_MEMBERS, layer: int = LAYER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """All nodes of the trie of `turns` (conv_id, depth, total, digest, words) and `members` (conv_id, total).

    Returns `conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256`; no rows
    without members. A node's ids are hashed in order, one node in one task, holding the hash alone.
    """
    prefixes = stored(prefix_rows(turns, layer), "prefixes")
    heavy = max(heavy, prefixes.count() // TOP_ROWS)
    nodes = stored(prefix_nodes(prefixes, heavy, layer), "nodes")
    light, top = nodes.where("NOT is_heavy"), nodes.where("is_heavy")
    sizes = {r["layer"]: r["count"] for r in light.groupBy("layer").count().collect()}

    settled, handed, to_top = [], None, []
    for k in sorted(sizes, reverse=True):
        here = light.where(F.col("layer") == k)
        dealt = _with_handed(here, handed).withColumn("shard", F.pmod(F.xxhash64("root1", "root2"), F.lit(sizes[k] // shard_rows + 1)))
        sums = stored(dealt.select("shard", *_TAKEN).groupBy("shard").applyInArrow(_settle, _SUMS), "sums")
        firsts = here.where("starts")
        handed = _handed_up(firsts.where("NOT below_heavy"), sums)
        to_top.append(_handed_up(firsts.where("below_heavy"), sums))
        settled.append(sums)
    for_top = None
    for part in to_top:
        for_top = part if for_top is None else for_top.unionByName(part)
    if for_top is not None:
        for_top = for_top.groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in ("in_children", "in_leaves", "in_saved")])
    nothing = F.lit(0).cast("long")
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(nothing.alias("depth"), nothing.alias("p1"), nothing.alias("p2"), F.lit(-1).cast("long").alias("q1"), F.lit(-1).cast("long").alias("q2"), "conv_id", "n_convs", nothing.alias("words"))
    above = root.unionByName(top.select(*root.columns))
    sums = stored(_with_handed(above, for_top).select(F.lit(0).alias("shard"), *_TAKEN).groupBy("shard").applyInArrow(_settle, _SUMS), "sums")
    settled.append(sums)

    every = settled[0]
    for part in settled[1:]:
        every = every.unionByName(part)
    plain = nodes.select(*NODE, "q1", "q2", "conv_id", "n_convs", (F.col("starts") & F.col("below_heavy")).alias("top_start"), "starts")
    plain = plain.unionByName(root.select(*NODE, "q1", "q2", "conv_id", "n_convs", F.lit(False).alias("top_start"), F.lit(False).alias("starts")))
    joined = plain.join(every, NODE)
    # Parents of subtrees' first nodes stand in another shard or in the top.
    inside = joined.where("NOT starts")
    firsts = joined.where("starts").drop("parent_conv_id")
    heads = above.select(F.col("depth").alias("d"), F.col("p1").alias("x1"), F.col("p2").alias("x2"), F.col("conv_id").alias("parent_conv_id"))
    cuts = nodes.where((F.col("depth") % layer == 0) & ~F.col("is_heavy")).select(F.col("depth").alias("d"), F.col("p1").alias("x1"), F.col("p2").alias("x2"), F.col("conv_id").alias("parent_conv_id"))
    on = (F.col("depth") - 1 == F.col("d")) & (F.col("q1") == F.col("x1")) & (F.col("q2") == F.col("x2"))
    under = firsts.where("top_start").join(F.broadcast(heads), on)  # at most TOP_ROWS and the root
    deep = firsts.where("NOT top_start").join(cuts, on)
    rows = inside.unionByName(under.select(*inside.columns)).unionByName(deep.select(*inside.columns))

    ends = prefixes.where("depth = total").select(*NODE, "conv_id")
    ends = ends.unionByName(members.where("total = 0").select(nothing.alias("depth"), nothing.alias("p1"), nothing.alias("p2"), "conv_id"))
    ends = ends.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(_ends, "depth long, p1 long, p2 long, ends_sha256 string")
    return rows.join(ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    )
