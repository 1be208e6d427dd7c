"""Prefix trie of conversations: double-array tries per prefix shard, merged to one trie."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockyard.operators.sequencing import running_many
from blockyard.session import materialize

#: Turns of one piece of a conversation: a trie is cut into storeys of this many levels, so that no row and no task
#: holds a whole long conversation.
STOREY = 64
#: Distinct pieces that one double array holds, about.
PIECES = 8192
#: Conversation ids that are joined into one string before they are hashed.
IDS = 4096
HALF = (1 << 32) - 1
#: A prefix is known by its depth and by the sums, over its turns, of four 32-bit hashes of (turn, depth): sums run on
#: over storeys and need no order.
SUMS = ["s1", "s2", "s3", "s4"]
NODE = ["depth", *SUMS]


def numbered_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, i, q1, q2, chars): each row's place in its conversation (0, 1, ..., by turn with null first, equal turns
    by role and text), its identity (two 64-bit hashes of role and text) and the code points of its text. Null role or
    text is an empty one; rows without a conversation are left out.

    Rows are range-sorted by conversation and turn and numbered by their place in that order, less the conversation's
    first place in the same range; a conversation of any length spreads over the ranges. Only prefixes of roles and
    texts enter the choice of ranges; texts go no further than this sort."""
    given = df.where(df[conv].isNotNull()).select(df[conv].alias("conv_id"), df[turn].alias("_turn"),
                                                  F.coalesce(df[role], F.lit("")).alias("_role"), F.coalesce(df[text], F.lit("")).alias("_text"))
    head = F.when(F.length("_role") < 64, F.substring("_text", 1, 64))
    ranges = given.repartitionByRange("conv_id", "_turn", F.substring("_role", 1, 64), head)
    placed = ranges.sortWithinPartitions("conv_id", F.col("_turn").asc_nulls_first(), "_role", "_text") \
        .select("conv_id", F.monotonically_increasing_id().alias("_at"), F.xxhash64("_role", "_text").alias("q1"),
                F.xxhash64("_text", F.lit(1), "_role").alias("q2"), F.length("_text").cast("long").alias("chars"))
    placed = materialize(placed, "turns").withColumn("_range", F.shiftright("_at", 33))
    parts = placed.groupBy("conv_id", "_range").agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_from")).drop("_n", "_from")
    return materialize(placed.join(parts, ["conv_id", "_range"])
                       .select("conv_id", (F.col("_at") + F.col("_before")).alias("i"), "q1", "q2", "chars"), "turns")


def rebuilt_turns(turns: DataFrame, base: Column, opening: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from numbered turns: the first `opening` (at most `most`) turns of conversation `base`,
    then the own turns after as many; both columns are expressions over conv_id. Returns (convs, turns): one row per
    conversation, even without a turn left, and the turns, with conv_id, depth from 1."""
    convs = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("n"))
                        .withColumn("_base", base).withColumn("_open", opening.cast("long")), "conversations")
    sizes = convs.select(F.col("conv_id").alias("_base"), F.col("n").alias("_has"))
    convs = materialize(convs.join(sizes, "_base", "left")
                        .withColumn("_taken", F.least("_open", F.coalesce("_has", F.lit(0)))).drop("_has", "n"), "conversations")
    own = turns.join(convs, "conv_id").where("i >= _open") \
        .select("conv_id", (F.col("i") - F.col("_open") + F.col("_taken") + 1).alias("depth"), "q1", "q2", "chars")
    heads = turns.where(F.col("i") < most).withColumnRenamed("conv_id", "_base")
    opened = convs.where("_taken > 0").select("conv_id", "_base", "_taken").join(heads, "_base").where("i < _taken") \
        .select("conv_id", (F.col("i") + 1).alias("depth"), "q1", "q2", "chars")
    return convs.select("conv_id"), own.unionByName(opened)


class DoubleArray:
    """A trie packed into two arrays: the child of slot s by symbol c is t = base[s] + c, if check[t] == s. The root is
    slot 0. Symbols are dense numbers from 0."""

    def __init__(self, paths: list[np.ndarray], sizes: np.ndarray, symbols: int):
        """paths[k]: symbol k of each path, for the paths with sizes > k (-1 elsewhere)."""
        self.base = np.zeros(1, np.int64)
        self.check = np.full(1, -2, np.int64)
        self.top, self.gap = 1, 1  # first slot above all used ones; no free slot below `gap`
        at = np.zeros(len(sizes), np.int64)
        for k, symbol in enumerate(paths):
            live = np.flatnonzero(sizes > k)
            edges, of = np.unique(at[live] * symbols + symbol[live], return_inverse=True)
            slots = self._place(edges // symbols, edges % symbols)
            at[live] = slots[of]

    def _reserve(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.r_[self.base, np.zeros(more, np.int64)]
            self.check = np.r_[self.check, np.full(more, -1, np.int64)]

    def _free(self, n: int) -> np.ndarray:
        """The first n free slots."""
        self._reserve(self.top + n)
        width = 4 * n + 64
        while True:
            free = np.flatnonzero(self.check[self.gap:self.gap + width] == -1)[:n] + self.gap
            if len(free) == n:
                self.gap = int(free[0]) if n else self.gap
                return free
            width *= 4

    def _place(self, parents: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Slots for the children (parent slot, symbol), sorted by both, none of which has a place yet."""
        starts = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]]) if len(parents) else np.array([], int)
        counts = np.diff(np.r_[starts, len(parents)])
        out = np.empty(len(parents), np.int64)
        for s, n in zip(starts[counts > 1].tolist(), counts[counts > 1].tolist()):
            c = symbols[s:s + n]
            trial = self._free(32)  # the first child in one of the first free slots, if the others fit then
            self._reserve(int(trial[-1] + c[-1] - c[0]) + 1)
            fits = (self.check[trial[:, None] + (c - c[0])[None, :]] == -1).all(axis=1) if n <= 512 else np.zeros(32, bool)
            first = int(trial[fits.argmax()]) if fits.any() else self.top
            out[s:s + n] = self._take(int(parents[s]), first - int(c[0]), c)
        single = starts[counts == 1]
        free = self._free(len(single))  # an only child fits anywhere
        self.base[parents[single]] = free - symbols[single]
        self.check[free] = parents[single]
        out[single] = free
        self.top = max(self.top, int(free[-1]) + 1 if len(free) else 0)
        return out

    def _take(self, parent: int, base: int, c: np.ndarray) -> np.ndarray:
        self._reserve(int(base + c[-1]) + 1)
        self.base[parent], self.check[base + c] = base, parent
        self.top = max(self.top, int(base + c[-1]) + 1)
        return base + c

    def step(self, slots: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children of slots by symbols; -1 where there is none."""
        to = self.base[slots] + symbols
        inside = (to >= 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == slots), to, -1)


def _halves(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x.view(np.uint64), y.view(np.uint64)
    return np.stack([x & np.uint64(HALF), x >> np.uint64(32), y & np.uint64(HALF), y >> np.uint64(32)], axis=1).astype(np.int64)


def shard_nodes(t: pa.Table, storey: int) -> pa.Table:
    """The nodes of a shard: its pieces are packed into a double array, which each piece then walks. A piece's first
    symbol stands for the prefix before it, so one array holds the pieces of many prefixes. storey: levels of a piece."""
    t = t.combine_chunks()
    turns = t["turns"].chunk(0) if t.num_rows else None
    flat, bounds = turns.flatten(), turns.offsets.to_numpy()
    bounds = bounds - bounds[0]
    q1, q2, x, y, chars = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("q1", "q2", "x", "y", "chars"))
    n, sizes = t.num_rows, np.diff(bounds)
    before = np.stack([t[c].to_numpy() for c in ("storey", "p1", "p2", "p3", "p4")], axis=1)
    entries, entry = np.unique(before, axis=0, return_inverse=True)
    # dense turn ids, in the order of first appearance by depth, so that siblings have close numbers
    level = np.arange(len(q1)) - np.repeat(bounds[:-1], sizes)
    by_level = np.argsort(level, kind="stable")
    _, seen, dense = np.unique(np.stack([q1, q2], axis=1)[by_level], axis=0, return_index=True, return_inverse=True)
    rank = np.empty(len(seen), np.int64)
    rank[np.argsort(seen)] = np.arange(len(seen))
    symbol = np.empty(len(q1), np.int64)
    symbol[by_level] = rank[dense.ravel()] + len(entries)
    paths = [entry.ravel().astype(np.int64)]
    for k in range(int(sizes.max())):
        live = sizes > k
        column = np.full(n, -1, np.int64)
        column[live] = symbol[bounds[:-1][live] + k]
        paths.append(column)
    trie = DoubleArray(paths, sizes + 1, len(entries) + len(rank))

    sums = np.cumsum(_halves(x, y), axis=0)
    start = np.where(bounds[:-1, None] > 0, sums[np.maximum(bounds[:-1] - 1, 0)], 0)
    count, least, turn = (np.zeros(len(trie.check), np.int64) for _ in range(3))
    least[:] = np.iinfo(np.int64).max
    of = np.full(len(trie.check), -1, np.int64)
    weight, smallest = t["n"].to_numpy(), t["least"].to_numpy()
    at = trie.step(np.zeros(n, np.int64), paths[0])
    for k in range(1, len(paths)):
        live = np.flatnonzero(sizes >= k)
        at[live] = trie.step(at[live], paths[k][live])
        np.add.at(count, at[live], weight[live])
        np.minimum.at(least, at[live], smallest[live])
        of[at[live]], turn[at[live]] = live, bounds[live] + k - 1
    node = np.flatnonzero(of >= 0)
    of, turn = of[node], turn[node]
    prefix = before[of, 1:] + sums[turn] - start[of]
    depth = before[of, 0] * storey + turn - bounds[of] + 1
    cols = [depth, *prefix.T, x[turn], y[turn], chars[turn], count[node], least[node]]
    return pa.table([pa.array(np.ascontiguousarray(c, np.int64)) for c in cols], [*NODE, "x", "y", "chars", "n", "least"])


def trie_nodes(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends): the distinct prefixes with their number of conversations `n` and smallest conversation `least`, and
    where each conversation ends. convs: conv_id, each once; turns: conv_id, depth (1, 2, ... without a gap), q1, q2,
    chars."""
    hashed = turns.withColumn("x", F.xxhash64("q1", "q2", "depth")).withColumn("y", F.xxhash64("depth", "q2", "q1"))
    half = [F.col("x").bitwiseAND(F.lit(HALF)), F.shiftrightunsigned("x", 32), F.col("y").bitwiseAND(F.lit(HALF)), F.shiftrightunsigned("y", 32)]
    pieces = materialize(hashed.withColumn("storey", F.floor((F.col("depth") - 1) / STOREY).cast("long")).groupBy("conv_id", "storey").agg(
        F.sort_array(F.collect_list(F.struct("depth", "q1", "q2", "x", "y", "chars"))).alias("turns"),
        *[F.sum(h).alias(s) for h, s in zip(half, SUMS)]), "conv-pieces")
    ends = convs.join(pieces.groupBy("conv_id").agg(F.max(F.element_at("turns", -1)["depth"]).alias("depth"), *[F.sum(s).alias(s) for s in SUMS]),
                      "conv_id", "left").na.fill(0, NODE)
    before = [(F.col(s), f"p{k}", "sum", False) for k, s in enumerate(SUMS, 1)]
    prefixes = [f"p{k}" for k in range(1, 5)]
    sums = running_many(pieces.select("conv_id", "storey", *SUMS), ["conv_id"], ["storey"], before, F.floor(F.col("storey") / 4096)) \
        .na.fill(0, prefixes).drop(*SUMS)
    key = ["storey", *prefixes, *SUMS]
    units = materialize(pieces.join(sums, ["conv_id", "storey"]).groupBy(*key).agg(  # equal pieces after equal prefixes are one
        F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("turns").alias("turns")), "conv-units")
    shards = max(1, math.ceil(units.count() / PIECES))
    # a prefix before very many pieces, such as the root, is dealt out to several shards
    hot = units.groupBy("storey", *prefixes).agg(F.ceil(F.count("*") / PIECES).alias("_parts")).where("_parts > 1")
    dealt = units.join(hot, ["storey", *prefixes], "left") \
        .withColumn("_part", F.pmod(F.xxhash64(*SUMS), F.coalesce("_parts", F.lit(1)))) \
        .withColumn("shard", F.pmod(F.xxhash64("storey", *prefixes, "_part"), F.lit(shards)))
    storey = STOREY
    found = dealt.select("shard", "storey", *prefixes, "n", "least", "turns").groupBy("shard").applyInArrow(
        lambda t: shard_nodes(t, storey), ", ".join(f"{c} bigint" for c in [*NODE, "x", "y", "chars", "n", "least"]))
    # nodes above a part are in several shards: their counts are added up
    nodes = found.groupBy(*NODE).agg(F.sum("n").alias("n"), F.min("least").alias("least"), *[F.min(c).alias(c) for c in ("x", "y", "chars")])
    root = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).where("n > 0") \
        .select(*[F.lit(0).cast("long").alias(c) for c in [*NODE, "x", "y", "chars"]], "n", "least")
    nodes = nodes.select(*root.columns).unionByName(root).withColumn("node", F.monotonically_increasing_id())
    return materialize(nodes, "conv-nodes"), ends


def subtree_sums(nodes: DataFrame, deepest: int, values: list[str]) -> DataFrame:
    """(node, *values): each value summed over the subtree, for nodes (node, up: the parent's number or null, *values).

    Pointer doubling: after k rounds a node has the sum over its descendants within 2**k - 1 levels and points 2**k
    levels up, so the rounds grow with the logarithm of the depth. Each round is written."""
    for _ in range(max(1, math.ceil(math.log2(deepest + 1)))):
        added = nodes.where("up is not null").groupBy(F.col("up").alias("node")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        above = nodes.select(F.col("node").alias("up"), F.col("up").alias("_up"))
        nodes = materialize(nodes.join(added, "node", "left").join(above, "up", "left")
                            .select("node", F.col("_up").alias("up"), *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]), "conv-sums")
    return nodes.drop("up")


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, chunk, ids) sorted by node and chunk to (node, sha256 of all ids, comma-joined), a chunk at a time."""
    current, digest = None, None
    for batch in batches:
        done = []
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if node != current:
                if digest is not None:
                    done.append((current, digest.hexdigest()))
                current, digest = node, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node, that is per distinct sequence of first turns, from the textless root: conv_id (the smallest
    conversation that starts so), depth, parent_conv_id (the parent's conv_id), n_convs, n_children, n_leaves (childless
    nodes of its subtree), saved_tokens (over its subtree, conversations but one times the code points of the last
    text) and ends_sha256 (of the sorted ids of the conversations that end there, comma-joined).

    convs: every conversation's conv_id, each once, even without a turn; turns: conv_id, depth (1, 2, ...), identity
    q1, q2 and chars of each turn. Conversations are cut into pieces of STOREY turns, and equal pieces after equal
    prefixes are one unit, so copies cost one row. Each shard packs its units into a double array over dense turn ids
    and walks it; nodes that several shards share are merged by adding up. Turns, and prefixes, are equal where their
    128-bit hashes are. Without conversations there is no row, not even a root."""
    nodes, ends = trie_nodes(convs, turns)
    deepest = nodes.agg(F.max("depth")).collect()[0][0] or 0
    x, y = F.col("x"), F.col("y")
    last = [x.bitwiseAND(F.lit(HALF)), F.shiftrightunsigned(x, 32), y.bitwiseAND(F.lit(HALF)), F.shiftrightunsigned(y, 32)]
    child = nodes.where("depth > 0").select("node", (F.col("depth") - 1).alias("depth"), *[(F.col(s) - h).alias(s) for s, h in zip(SUMS, last)])
    parent = materialize(child.join(nodes.select(*NODE, F.col("node").alias("up"), F.col("least").alias("parent_conv_id")), NODE)
                         .select("node", "up", "parent_conv_id"), "conv-parents")
    kids = parent.groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n_children"))
    whole = materialize(nodes.join(parent, "node", "left").join(kids, "node", "left").select(
        "node", "up", "depth", "parent_conv_id", F.col("least").alias("conv_id"), F.col("n").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n") - 1) * F.col("chars")).alias("saved_tokens"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves")), "conv-trie")
    sums = subtree_sums(whole.select("node", "up", "n_leaves", "saved_tokens"), deepest, ["n_leaves", "saved_tokens"])
    lists = ends.join(nodes.select(*NODE, "node"), NODE).groupBy("node", F.floor(F.col("conv_id") / IDS).alias("chunk")) \
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    ended = lists.repartition("node").sortWithinPartitions("node", "chunk").mapInArrow(_hash_lists, "node bigint, ends_sha256 string")
    return whole.drop("up", "n_leaves", "saved_tokens").join(sums, "node").join(ended, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
