"""Tries of conversation prefixes, packed as double arrays over one range of prefixes each.

Every conversation is a path of turns below a root without text. Equal paths are combined before they are dealt out by
ranges of their turns, so that a shard is one range of prefixes, and a prefix with many conversations is spread over several.
A shard numbers its turns densely, packs BASE and CHECK, and walks all its paths through the arrays; the states it meets
are the nodes. Nodes that shards share are merged over the cluster by an aggregation, which also combines what shards hold in common.

Paths are cut into bands of ``BAND`` turns, so that a conversation of any length is walked by many tasks; the band's start goes in the
hash of all turns before. A node is known by its depth and the exclusive-or of 128-bit hashes of its turns at their depths.

Sums over subtrees need no walk upwards: a node is owned by its smallest member, the nodes that one conversation owns are the lower end of its
path, and so what lies under a node is owned by members of it. Each member's owned sum is carried down the tries as a second weight.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdpanel.operators.ranges import ranked

from .common import discard, stored

#: Turns of a path that one trie holds.
BAND = 256
#: Paths in a shard, and turns that one double array packs at once.
SHARD_PATHS, PACK_TURNS = 1 << 16, 1 << 16
#: Ids joined to one text before they are hashed in order.
ID_BLOCK = 1024
#: Words between white space: space and the control characters 9 to 13.
WORDS = "[^\\x20\\x09-\\x0D]+"


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, role, text), depth from 1: the turns of each conversation ordered by turn, null first, then role, then text.

    A null role or text is empty; rows without a conv_id belong to no conversation and are left out; repeated rows are turns of their own.
    """
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
    return ranked(rows, ["conv_id"], ["turn", "role", "text"], "depth").select("conv_id", "depth", "role", "text")


def rebuilt(turns: DataFrame, block: int = 20, kinds: int = 4) -> tuple[DataFrame, DataFrame]:
    """(convs, turns): all conversation ids, and the turns of conversations that share the opening of their block's first.

    Conversation c gets the first h turns of conversation c - c % block (all if it has fewer, none if there is none), then its own after
    its first h, with h = crc32(decimal c) % kinds. A conversation may end up without turns, and is still in ``convs``.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % kinds
    convs = stored(turns.groupBy("conv_id").agg(F.max("depth").alias("length")).withColumns({"h": head, "base": F.col("conv_id") - F.col("conv_id") % block}))
    bases = convs.select(F.col("conv_id").alias("base"), F.least("length", F.lit(kinds - 1)).alias("has"))
    taken = convs.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("taken"))
    opening = turns.where((F.col("depth") < kinds) & (F.col("conv_id") % block == 0)).select(F.col("conv_id").alias("base"), "depth", "role", "text")
    first = opening.join(taken.select("conv_id", "base", "taken"), "base").where("depth <= taken").select("conv_id", "depth", "role", "text")
    own = turns.join(taken, "conv_id").where("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "role", "text")
    return convs.select("conv_id"), first.unionByName(own)


def prefix_nodes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per distinct beginning of the conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` holds (conv_id, depth, role, text), depths 1, 2 … of each conversation without gaps; ``convs`` all ids, also of conversations without turns,
    which are members of the root alone. conv_id is a node's smallest member, and with depth its key; the root has no parent. n_leaves counts childless nodes
    of the subtree, the node itself included; saved_tokens sums (n_convs - 1) x words of the last turn over it; ends_sha256 hashes the ids that end at the node.

    Equal conversations count each; texts of any length are hashed once, in the JVM; no conversations give no nodes. ``turns`` may
    have further columns under any names. ``with_turns`` adds role and text of each node's last turn.
    """
    number = lambda f, to: F.conv(F.substring(f, to, 16), 16, -10).cast("bigint")
    said = F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)
    rows = turns.select("conv_id", "depth", said.alias("s"), F.regexp_count("text", F.lit(WORDS)).cast("bigint").alias("words"))
    rows = rows.select("conv_id", "depth", F.xxhash64(number("s", 1), "depth").alias("k1"), F.xxhash64("depth", number("s", 17)).alias("k2"), "words")
    root = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), *[F.lit(0).cast("bigint").alias(c) for c in ("k1", "k2", "words")])
    banded = rows.unionByName(root).groupBy("conv_id", F.expr(f"depth div {BAND}").alias("band")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "k1", "k2", "words"))).alias("turns"), F.bit_xor("k1").alias("x1"), F.bit_xor("k2").alias("x2"))
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("conv_id").orderBy("band")
    banded = stored(banded.select("*", *[F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)).alias(f"p{i}") for i in (1, 2)], F.lead("band").over(after).isNull().alias("last")))
    key = ["band", "p1", "p2", "x1", "x2", "n_turns"]
    banded_key = banded.withColumn("n_turns", F.size("turns"))
    distinct = stored(banded_key.groupBy(*key).agg(F.any_value("turns").alias("turns"), F.count("*").alias("a"), F.lit(0).cast("bigint").alias("b"), F.min("conv_id").alias("least")))
    nodes = _merged(distinct)
    parents = nodes.select(F.col("e1").alias("q1"), F.col("e2").alias("q2"), (F.col("depth") + 1).alias("depth"), F.col("least").alias("parent_conv_id"))
    children = nodes.groupBy(F.col("q1").alias("e1"), F.col("q2").alias("e2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(parents, ["q1", "q2", "depth"], "left").join(children, ["e1", "e2", "depth"], "left").select(
        "e1", "e2", "depth", F.col("least").alias("conv_id"), "parent_conv_id", F.col("a").alias("n_convs"), F.coalesce("n_children", F.lit(0)).alias("n_children"),
        ((F.col("a") - 1) * F.col("words")).alias("own")))

    owned = nodes.groupBy("conv_id").agg(F.sum("own").alias("own"), F.count(F.when(F.col("n_children") == 0, 1)).alias("leaf")).where("own > 0 or leaf > 0")
    weight = banded_key.select("conv_id", *key).join(owned, "conv_id").groupBy(*key).agg(F.sum("leaf").alias("a"), F.sum("own").alias("b"))
    under = _merged(distinct.drop("a", "b").join(weight, key).select(distinct.columns))
    higher = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    above = nodes.withColumn("above", F.coalesce(F.sum("own").over(higher), F.lit(0)))
    ends = _digests(banded_key.where("last").select("conv_id", F.col("p1").bitwiseXOR(F.col("x1")).alias("e1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("e2"),
                                                    F.get("turns", F.col("n_turns") - 1)["depth"].alias("depth")))
    return (above.join(under.select("e1", "e2", "depth", F.col("a").alias("n_leaves"), "b"), ["e1", "e2", "depth"]).join(ends, ["e1", "e2", "depth"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("b") - F.col("above")).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))


def with_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with role and text of their last turn; null for the root."""
    return nodes.join(turns.select("conv_id", "depth", "role", "text"), ["conv_id", "depth"], "left")


def _digests(ends: DataFrame) -> DataFrame:
    """(e1, e2, depth, ends_sha256): SHA-256 of the sorted, comma-joined ids of each node; ids come as texts of one block each, in order."""
    block = F.expr(f"(conv_id - pmod(conv_id, {ID_BLOCK}))")
    texts = ends.groupBy("e1", "e2", "depth", block.alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    schema = "e1 bigint, e2 bigint, depth bigint, ends_sha256 string"

    def run(batches):
        key, state = None, None
        for b in batches:
            out = []
            for *here, _, ids in zip(*(c.to_pylist() for c in b.columns)):
                if here != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = here, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["e1", "e2", "depth", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], ["e1", "e2", "depth", "ends_sha256"])

    return texts.repartition("e1", "e2", "depth").sortWithinPartitions("e1", "e2", "depth", "block").select("e1", "e2", "depth", "block", "ids").mapInArrow(run, schema)


def _merged(distinct: DataFrame) -> DataFrame:
    """Nodes (e1, e2, depth) with parent (q1, q2), words, sums a and b and the smallest ``least`` of the paths through them, over all shards."""
    shards = max(1, math.ceil(distinct.count() / SHARD_PATHS))
    keys = F.transform("turns", lambda t: F.struct(t["k1"].alias("k1"), t["k2"].alias("k2")))
    dealt = distinct.withColumn("path", keys).repartitionByRange(shards, "band", "p1", "p2", "path").select("band", "p1", "p2", "turns", "a", "b", "least")
    nodes = dealt.mapInArrow(_shard, "e1 bigint, e2 bigint, depth bigint, q1 bigint, q2 bigint, words bigint, a bigint, b bigint, least bigint")
    return nodes.groupBy("e1", "e2", "depth").agg(F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("words").alias("words"), F.sum("a").alias("a"), F.sum("b").alias("b"),
                                                  F.min("least").alias("least"))


def _shard(batches):
    for b in batches:
        at = 0
        while at < b.num_rows:
            ends = b.column(3).slice(at).offsets.to_numpy()
            to = at + max(1, int(np.searchsorted(ends, ends[0] + PACK_TURNS, side="right")) - 1)
            yield _walked(b.slice(at, to - at))
            at = to


def _walked(rows: pa.RecordBatch) -> pa.RecordBatch:
    band, p1, p2, turns, a, b, least = rows.columns
    offs = turns.offsets.to_numpy()
    size, start = np.diff(offs), offs[:-1] - offs[0]
    depth, k1, k2, words = (turns.flatten().field(i).to_numpy() for i in range(4))
    band, p1, p2, a, b, least = (c.to_numpy() for c in (band, p1, p2, a, b, least))
    codes = dense_ids([np.concatenate([p1, k1]), np.concatenate([p2, k2])], np.concatenate([-1 - band, depth]))
    opening, turn = codes[:len(band)], codes[len(band):]
    path = np.full((len(band), 1 + int(size.max())), 0, np.int64)
    path[:, 0] = opening
    inside = np.arange(path.shape[1] - 1) < size[:, None]
    path[:, 1:][inside] = turn
    trie = DoubleArray(path)
    state = np.zeros(len(path), np.int64)
    n = len(trie.base)
    sums = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
    low = np.full(n, np.iinfo(np.int64).max)
    e1, e2, deep, said, up1, up2 = (np.zeros(n, np.int64) for _ in range(6))
    for level in range(path.shape[1]):
        on = np.flatnonzero(path[:, level] > 0)
        to = trie.step(state[on], path[on, level])
        if level == 0:
            e1[to], e2[to] = p1[on], p2[on]
        else:
            at, was = start[on] + level - 1, state[on]
            up1[to], up2[to] = e1[was], e2[was]
            e1[to], e2[to] = e1[was] ^ k1[at], e2[was] ^ k2[at]
            deep[to], said[to] = depth[at], words[at]
            np.add.at(sums[0], to, a[on])
            np.add.at(sums[1], to, b[on])
            np.minimum.at(low, to, least[on])
        state[on] = to
    met = np.flatnonzero(low < np.iinfo(np.int64).max)
    return pa.RecordBatch.from_arrays([pa.array(c[met]) for c in (e1, e2, deep, up1, up2, said, *sums, low)], ["e1", "e2", "depth", "q1", "q2", "words", "a", "b", "least"])


def dense_ids(keys: list[np.ndarray], kind: np.ndarray) -> np.ndarray:
    """Numbers 1, 2 … of the distinct tuples of the given columns."""
    out = kind
    for k in keys:
        ids = np.unique(k, return_inverse=True)[1]
        out = np.unique(np.unique(out, return_inverse=True)[1] * (int(ids.max()) + 1) + ids, return_inverse=True)[1]
    return out + 1


class DoubleArray:
    """BASE and CHECK of the trie of the rows of ``path``; codes are 1, 2 …, 0 behind a row's end. State 0 is the start.

    The child of state s by code c is base[s] + c, if check there is s. Levels are packed in turn: states with several children
    first, each at the first free slot that fits among the lowest free ones or behind the last used, then all states with one child in the slots left over.
    """

    def __init__(self, path: np.ndarray):
        top = int(path.max()) + 1
        self.base, self.check = np.zeros(2 * top, np.int64), np.full(2 * top, -1, np.int64)
        self.check[0], self.top, self.span = 0, top, top
        state = np.zeros(len(path), np.int64)
        for level in range(path.shape[1]):
            on = np.flatnonzero(path[:, level] > 0)
            edge = np.unique(state[on] * self.span + path[on, level])
            parent, code = edge // self.span, edge % self.span
            owner, first, count = np.unique(parent, return_index=True, return_counts=True)
            for i in np.flatnonzero(count > 1):
                self._place(owner[i], code[first[i]:first[i] + count[i]])
            alone = np.flatnonzero(count == 1)
            self._fill(owner[alone], code[first[alone]])
            state[on] = self.step(state[on], path[on, level])

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        to = self.base[state] + code
        if (self.check[to] != state).any():
            raise ValueError("path is not in the trie")
        return to

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _free(self, n: int) -> np.ndarray:
        """The n lowest free slots that any code can reach from a base of 0 or more."""
        self._grow(self.top + n + self.span)
        return self.span + np.flatnonzero(self.check[self.span:self.top + n] < 0)[:n]

    def _place(self, owner: int, codes: np.ndarray) -> None:
        gap = codes - codes[0]
        slots = self._free(32)
        self._grow(self.top + 32 + self.span)
        fits = np.flatnonzero((self.check[slots[:, None] + gap] < 0).all(axis=1))
        at = slots[fits[0]] if len(fits) else self.top
        self.base[owner] = at - codes[0]
        self.check[at + gap] = owner
        self.top = max(self.top, int(at + gap[-1]) + 1)

    def _fill(self, owner: np.ndarray, code: np.ndarray) -> None:
        if len(owner):
            slots = self._free(len(owner))
            self.base[owner] = slots - code
            self.check[slots] = owner
            self.top = max(self.top, int(slots[-1]) + 1)
