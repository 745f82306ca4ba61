"""Trie of conversation prefixes as balanced parentheses, one sequence of them per shard.

Conversations are sequences of turns; a turn counts by a digest of its role and text. They
are sorted and cut into shards by range. A shard writes the trie of its sequences as
balanced parentheses. The excess (opened less closed) is kept with its minimum per block of
``BITS`` and a tree above the blocks, so that ``findclose`` finds the end of a subtree
without reading it. What a node reports is a difference between the two ends of its subtree:
leaves by the rank of the pairs ``()``, conversations and saved words by cumulative arrays.

A node that occurs in several shards lies on the first or last path of each of them. These
spines (two per shard) carry the sums of what hangs off them; they are merged, in order, into
a trie of their own that is solved the same way. So a prefix that a third of all
conversations share is spread over the shards like any other, and copies of one
conversation are cut by their number.

Conversations are told apart by ``conv_id`` (a whole number); rows without one are left out.
Turns are ordered by turn (nulls first), then role, then the first ``TIE_CHARS`` characters of the
text, then its digest. Null roles and texts count as empty. Empty tables give no nodes, not
even a root. Other columns are left out. Texts of any length are digested where they are
read; of a conversation's turns the digests and word counts are held in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telelake.llm.rows import row_step, store

# Parentheses in a block of the excess.
BITS = 256
# Turns in a shard, about.
SHARD_TURNS = 500_000
TIE_CHARS = 64
WORD = r"[^\x20\x09-\x0D]+"
NONE = (1 << 63) - 1


class Parentheses:
    """A trie, given by the depths of its nodes in preorder, as balanced parentheses."""

    def __init__(self, depths: np.ndarray):
        count = len(depths)
        closed = np.zeros(count + 1, np.int64)  # before each node and at the end
        closed[1:count] = depths[:-1] - depths[1:] + 1
        closed[count] = depths[-1] + 1
        self.opens = np.arange(count) + np.cumsum(closed)[:count]
        steps = np.full(2 * count, -1, np.int64)
        steps[self.opens] = 1
        self.steps, self.excess = steps, np.cumsum(steps)
        blocks = -(-len(steps) // BITS)
        width = 1 << max(0, blocks - 1).bit_length()
        self.tree = np.full(2 * width, np.iinfo(np.int64).max)
        self.tree[width : width + blocks] = np.minimum.reduceat(self.excess, np.arange(blocks) * BITS)
        for node in range(width - 1, 0, -1):
            self.tree[node] = min(self.tree[2 * node], self.tree[2 * node + 1])
        self.width = width
        self.rank = np.cumsum(steps == 1)
        pair = np.zeros(len(steps), bool)
        pair[:-1] = (steps[:-1] == 1) & (steps[1:] == -1)
        self.leaf = pair[self.opens]
        # Number of the last node of each subtree.
        closes = self.opens + 1
        for node in np.flatnonzero(~self.leaf):
            closes[node] = self.findclose(int(self.opens[node]))
        self.last = self.rank[closes] - 1

    def findclose(self, at: int) -> int:
        """Position of the parenthesis that closes the one opened at ``at``."""
        target = self.excess[at] - 1
        block = at // BITS
        found = self._first(at + 1, (block + 1) * BITS, target)
        if found is not None:
            return found
        node = block + self.width
        while node & 1 or self.tree[node + 1] > target:
            node >>= 1
        node += 1
        while node < self.width:
            node = 2 * node if self.tree[2 * node] <= target else 2 * node + 1
        begin = (node - self.width) * BITS
        return self._first(begin, begin + BITS, target)

    def _first(self, begin: int, end: int, target: int) -> int | None:
        low = self.excess[begin:end] <= target
        place = int(low.argmax()) if len(low) else 0
        return begin + place if len(low) and low[place] else None

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sum of ``values`` over the subtree of each node."""
        upto = np.concatenate(([0], np.cumsum(values)))
        return upto[self.last + 1] - upto[:-1]

    def least(self, values: np.ndarray) -> np.ndarray:
        """Minimum of ``values`` over the subtree of each node, by a table of powers of two."""
        first = np.arange(len(values))
        power = np.frexp((self.last - first + 1).astype(float))[1] - 1
        found, level = np.empty_like(values), values
        for k in range(int(power.max()) + 1):
            own = power == k
            found[own] = np.minimum(level[first[own]], level[self.last[own] - (1 << k) + 1])
            if len(level) > 1 << k:
                level = np.minimum(level[: -(1 << k)], level[1 << k :])
        return found


class Trie:
    """Nodes in preorder, built from sequences in order."""

    def __init__(self):
        self.depths, self.words, self.parents = [0], [0], [-1]
        self.path: list[int] = [0]
        self.keys: list[bytes] = []

    def add(self, keys: list[bytes], words: list[int]) -> tuple[int, int]:
        """The node of a sequence, and how many turns it shares with the one before."""
        shared, top = 0, min(len(keys), len(self.keys))
        while shared < top and keys[shared] == self.keys[shared]:
            shared += 1
        del self.path[shared + 1 :]
        for depth in range(shared, len(keys)):
            self.path.append(len(self.depths))
            self.parents.append(self.path[depth])
            self.depths.append(depth + 1)
            self.words.append(words[depth])
        self.keys = keys
        return self.path[-1], shared

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.array(x, np.int64) for x in (self.depths, self.words, self.parents))


# What hangs off a spine node in a shard: conversations, leaves, saved words, children, smallest conversation.
WEIGHTS = 5
NODE = "conv_id bigint, depth bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
# ``owner`` is the smallest conversation of the parent (nodes) or of the own node (ends); if that
# node is on a spine, ``side`` names it together with shard and depth.
FOUND = (
    f"kind string, shard int, side int, owner bigint, {NODE},"
    " keys array<binary>, words array<bigint>, weights array<array<bigint>>"
)


def _shard(rows: list[tuple], shard: int) -> Iterator[tuple]:
    """Nodes and ends of a shard's trie, and its two spines; rows are (conversation, keys, words) in order."""
    trie, ends, left = Trie(), [], []
    for conv, keys, words in rows:
        node, shared = trie.add(keys, words)
        ends.append((conv, node))
        left = left or list(trie.path)
    right = list(trie.path)
    shared = sum(1 for a, b in zip(left, right, strict=False) if a == b)
    depths, words, parents = trie.arrays()
    tree = Parentheses(depths)
    side = np.full(len(depths), -1)
    side[right] = 1
    side[left] = 0
    own = np.zeros(len(depths), np.int64)
    low = np.full(len(depths), NONE)
    for conv, node in ends:
        own[node] += 1
        low[node] = min(low[node], conv)
    spine = side >= 0
    convs, least = tree.total(own), tree.least(low)
    # Spine nodes may have more in other shards; what they save and whether they are leaves shows in the merge.
    saved = tree.total(np.where(spine, 0, (convs - 1) * words))
    leaves = tree.total(tree.leaf & ~spine)
    children = np.bincount(parents[1:], minlength=len(depths))
    weights = np.zeros((len(depths), WEIGHTS), np.int64)
    weights[:, 0], weights[:, 4] = own, low
    hanging = np.flatnonzero(~spine & spine[parents])
    for column, values in enumerate((convs, leaves, saved, np.ones_like(convs))):
        np.add.at(weights[:, column], parents[hanging], values[hanging])
    np.minimum.at(weights[:, 4], parents[hanging], least[hanging])

    def names(node: int) -> tuple:
        return (int(side[node]), None) if spine[node] else (None, int(least[node]))

    nothing = (None,) * 3
    for node in np.flatnonzero(~spine):
        numbers = (least[node], depths[node], convs[node], children[node], leaves[node], saved[node])
        yield "node", shard, *names(parents[node]), *map(int, numbers), *nothing
    for conv, node in ends:
        yield "end", shard, *names(node), conv, int(depths[node]), *[None] * 4, *nothing
    paths = [(0, left, 0, rows[0])] + [(1, right, shared, rows[-1])] * (left != right)
    for place, path, first, (_, keys, counts) in paths:
        held = weights[path]
        # What both spines share is counted on the first one.
        held[:first] = (0, 0, 0, 0, NONE)
        yield "spine", shard, place, None, None, len(path), *[None] * 4, keys, counts, held.tolist()


MERGED = f"shard int, side int, node boolean, parent_conv_id bigint, {NODE}"


def _merge(records: Iterator[tuple]) -> Iterator[tuple]:
    """Nodes of the merged spines, and for each place on a spine the node that it is."""
    trie, weights, places = Trie(), [[0, 0, 0, 0, NONE]], []
    for shard, side, keys, words, held in records:
        trie.add(keys, words)
        for depth, (node, weight) in enumerate(zip(trie.path, held, strict=True)):
            if node == len(weights):
                weights.append([0, 0, 0, 0, NONE])
            into = weights[node]
            into[:4] = [a + b for a, b in zip(into[:4], weight[:4], strict=True)]
            into[4] = min(into[4], weight[4])
            places.append((shard, side, depth, node))
    if not places:
        return
    depths, words, parents = trie.arrays()
    held = np.array(weights, np.int64)
    tree = Parentheses(depths)
    convs, least = tree.total(held[:, 0]), tree.least(held[:, 4])
    saved = tree.total(held[:, 2] + (convs - 1) * words)
    leaves = tree.total(held[:, 1] + (tree.leaf & (held[:, 3] == 0)))
    children = np.bincount(parents[1:], minlength=len(depths)) + held[:, 3]
    done = set()
    for shard, side, depth, node in places:
        parent = int(least[parents[node]]) if node else None
        numbers = (least[node], depth, convs[node], children[node], leaves[node], saved[node])
        yield shard, side, node not in done, parent, *map(int, numbers)
        done.add(node)


def _of_shard(rows: Iterator[tuple]) -> Iterator[tuple]:
    held = list(rows)
    if held:
        yield from _shard(held, TaskContext.get().partitionId())


def sequences(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its turns in order, each with digest and words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit("/"), role, text)
    turn = F.struct(
        F.col("turn"),
        role.alias("role"),
        F.substring(text, 1, TIE_CHARS).alias("head"),
        F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("turn"))
    ordered = F.array_sort(F.collect_list("turn"))
    pairs = F.transform(ordered, lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(pairs.alias("turns"))


def build(found: DataFrame, shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends of the trie of ``found`` (conv_id, turns array<struct<key, words>>).

    Nodes: conv_id (smallest conversation that begins with the node's turns) and depth, which
    together name the node, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. Ends:
    the node (node_conv_id, depth) at which each conversation ends.
    """
    flat = store(
        found.select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.words").alias("words")), "trie-sequences"
    )
    if shards is None:
        turns = flat.agg(F.sum(F.size("keys"))).first()[0] or 0
        least = int(flat.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shards = max(least, -(-turns // SHARD_TURNS))
    ordered = flat.repartitionByRange(shards, "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    parts = store(row_step(ordered, _of_shard, FOUND), "trie-shards")
    # Two rows per shard.
    spines = parts.where("kind = 'spine'").select("shard", "side", "keys", "words", "weights")
    merged = store(
        row_step(spines.repartition(1).sortWithinPartitions("shard", "side"), _merge, MERGED), "trie-spines"
    )
    on = merged.select("shard", "side", F.col("depth").alias("at"), F.col("conv_id").alias("spine_conv"))

    def resolved(kind: str, at: Column) -> DataFrame:
        """Rows of a kind with the owner known, also where it is on a spine."""
        own = parts.where(F.col("kind") == kind).drop("keys", "words", "weights").withColumn("at", at)
        known = own.where("side is null").drop("shard", "side", "at")
        joined = own.where("side is not null").join(on, ["shard", "side", "at"])
        return known.unionByName(joined.withColumn("owner", F.col("spine_conv")).drop("shard", "side", "at", "spine_conv"))

    numbers = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    inner = resolved("node", F.col("depth") - 1).select("conv_id", "depth", F.col("owner").alias("parent_conv_id"), *numbers)
    nodes = inner.unionByName(merged.where("node").select("conv_id", "depth", "parent_conv_id", *numbers))
    ends = resolved("end", F.col("depth")).select("conv_id", F.col("owner").alias("node_conv_id"), "depth")
    return nodes, ends


HEADS = 3


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Sequences of the registered query: first turns of every twentieth conversation before own ones."""
    own = sequences(conversations)
    heads = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    joined = own.withColumn("base", F.expr("conv_id - conv_id % 20")).withColumn("_h", taken).join(heads, "base", "left")
    kept = F.expr("slice(turns, _h + 1, greatest(size(turns), 1))")
    before = F.coalesce(F.expr("slice(head, 1, _h)"), F.expr("slice(turns, 1, 0)"))
    return joined.select("conv_id", F.concat(before, kept).alias("turns"))


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Digest of the numbers of each group, streamed."""
    for (node, depth), group in groupby(rows, key=lambda row: row[:2]):
        digest, joint = hashlib.sha256(), ""
        for _, _, conv in group:
            digest.update(f"{joint}{conv}".encode())
            joint = ","
        yield node, depth, digest.hexdigest()


def nodes_with_ends(conversations: DataFrame) -> DataFrame:
    """The registered query: nodes of the rebuilt ``conversations`` and a digest of what ends at each."""
    nodes, ends = build(rebuilt(conversations))
    ordered = ends.select("node_conv_id", "depth", "conv_id").repartition("node_conv_id", "depth")
    ordered = ordered.sortWithinPartitions("node_conv_id", "depth", "conv_id")
    digests = row_step(ordered, _digests, "conv_id bigint, depth bigint, ends_sha256 string")
    joined = nodes.join(digests, ["conv_id", "depth"], "left")
    return joined.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
