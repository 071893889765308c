"""The prefix trie of conversations: a node for every distinct sequence of first turns, kept as flat arrays.

A turn is a digest; a prefix is the digest of the one before and its last turn, so a conversation is read once, row by
row, however long it is. Equal prefixes are counted before they are shuffled: a conversation that a third of the rows
repeat is a few rows. The distinct nodes are cut into shards of whole subtrees. In a shard a minimal perfect hash gives
every prefix digest a slot, checked against the digest that the slot holds; counts are scattered into flat arrays by
slot, and an array of parent slots carries sums upwards in order of depth.

Subtrees that are too large for a shard are cut below their top: the heavy nodes form a tree of their own, which is
small (``TOP_NODES`` at most) and takes its children's sums from the shards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.llm.store import written

#: A subtree whose members have fewer turns than this below its top stays whole; the bound doubles until few nodes exceed it.
SHARD_TURNS = 1 << 14
#: Nodes above the shards at most: a few megabytes that are sent to every executor, and one task's work.
TOP_NODES = 200_000
#: Ids that are written into one text before a node's texts are hashed.
ID_BITS = 12
ROOT = hashlib.sha256(b"").digest()


# --- turns and prefixes -------------------------------------------------------------------------------------------


def turns(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, place, digest, chars): the turns of each conversation, numbered from 1.

    They are ordered by ``turn`` (null first), turns of one number by the digest of role and text. A null role or text is
    empty. Rows without a conversation id belong to none and take no part; repeated rows are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.select(
        F.col(f"`{id_col}`").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars")
    ).where("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("place"), "digest", "chars")


def graft(numbered: DataFrame, base: Column, length: Column, most: int) -> DataFrame:
    """Conversations rebuilt: the first ``length`` turns of conversation ``base`` in place of their own first ones.

    Both are expressions over conv_id, ``length`` is ``most`` at most. A base that is absent, or shorter, gives no turns,
    or all that it has. Rows of turns that are joined are those of the heads alone, ``most`` a conversation.
    """
    own = numbered.where(F.col("place") > length)
    asked = numbered.where("place = 1").select("conv_id", base.alias("base"), length.alias("length"))
    heads = numbered.where(F.col("place") <= most).select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    begun = asked.join(heads, "base").where("place <= length").select("conv_id", "place", "digest", "chars")
    return own.unionByName(begun)


_PREFIXES = "conv_id long, depth long, left long, digest binary, parent binary, chars long"


def prefixes(numbered: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each prefix of each conversation of ``ids``, the empty one included; ``left`` turns come after it."""
    starts = ids.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    own = Window.partitionBy("conv_id").orderBy("place")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = numbered.unionByName(starts).select(
        "conv_id", (F.row_number().over(own) - 1).cast("long").alias("depth"), F.count(F.lit(1)).over(whole).alias("n"), "digest", "chars"
    )

    def chain(batches):
        conversation, at, digest = None, 0, ROOT
        for batch in batches:  # the window has put a conversation's rows one after the other
            ids, depths, sizes, digests = (batch.column(i).to_pylist() for i in range(4))
            found, above = [], []
            for c, d, turn in zip(ids, depths, digests, strict=True):
                if d == 0:
                    conversation, digest, parent = c, ROOT, None
                elif c == conversation and d == at + 1:
                    parent = digest
                    digest = hashlib.sha256(parent + turn).digest()
                else:
                    raise ValueError("turns are out of order")
                at = d
                found.append(digest)
                above.append(parent)
            left = pa.array(np.array(sizes, np.int64) - 1 - np.array(depths, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), left, pa.array(found, pa.binary()), pa.array(above, pa.binary()), batch.column(4)],
                names=["conv_id", "depth", "left", "digest", "parent", "chars"],
            )

    return rows.mapInArrow(chain, _PREFIXES)


# --- a shard ------------------------------------------------------------------------------------------------------


def _words(digests: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of 32 bytes as rows of four words, and which of them are there."""
    values = digests.to_pylist()
    return np.frombuffer(b"".join(v or bytes(32) for v in values), "<u8").reshape(-1, 4), np.array([v is not None for v in values], bool)


class Slots:
    """A minimal perfect hash of distinct digests: n digests have the slots 0 to n - 1, and every slot holds its digest.

    Digests that are alone in their place at a level have their slot there, the others go on to the next level.
    """

    ROOM = 1.5

    def __init__(self, words: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.slot = np.zeros(len(words), np.int64)
        rest, used = np.arange(len(words)), 0
        while len(rest):
            size = max(16, int(len(rest) * self.ROOM))
            place = self._place(words[rest], len(self.levels), size)
            taken = np.bincount(place, minlength=size) == 1
            rank = np.cumsum(taken) - 1 + used
            self.levels.append((taken, rank))
            alone = taken[place]
            self.slot[rest[alone]] = rank[place[alone]]
            used, rest = used + int(taken.sum()), rest[~alone]
            if len(self.levels) > 200:
                raise ValueError("digests are not distinct")
        self.held = np.zeros_like(words)
        self.held[self.slot] = words

    @staticmethod
    def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
        x = words[:, level % 4] + np.uint64((level // 4 + 1) * 0x9E3779B97F4A7C15 % 2**64) * words[:, (level + 1) % 4]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def find(self, words: np.ndarray) -> np.ndarray:
        """The slots of digests, -1 for those that are not held: a slot counts only if it holds the digest asked for."""
        out, rest = np.full(len(words), -1), np.arange(len(words))
        for level, (taken, rank) in enumerate(self.levels):
            place = self._place(words[rest], level, len(taken))
            out[rest[taken[place]]] = rank[place[taken[place]]]
            rest = rest[~taken[place]]
        at = np.flatnonzero(out >= 0)
        out[at[(self.held[out[at]] != words[at]).any(axis=1)]] = -1
        return out


_NODES = "digest binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long"


def _accumulated(shard: pa.Table) -> pa.Table:
    """The nodes of whole subtrees with their children, and the leaves and savings below them.

    ``more_children``, ``more_leaves`` and ``more_saved`` are what a node has from children outside of the shard.
    """
    words, _ = _words(shard["digest"])
    slots = Slots(words)
    up, there = _words(shard["parent"])
    by_slot = np.argsort(slots.slot)
    parent = np.where(there, slots.find(up), -1)[by_slot]
    number = lambda name: shard[name].to_numpy()[by_slot]
    depth, conv, n_convs = number("depth"), number("conv_id"), number("n_convs")
    children = np.bincount(parent[parent >= 0], minlength=len(parent)) + number("more_children")
    leaves = (children == 0) + number("more_leaves")
    saved = (n_convs - 1) * number("chars") + number("more_saved")
    order = np.argsort(-depth, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(depth[order])) + 1).tolist(), len(order)]
    for begin, end in zip(cuts, cuts[1:], strict=False):  # the deepest first: a node's sums are whole before they go up
        at = order[begin:end]
        at = at[parent[at] >= 0]
        np.add.at(leaves, parent[at], leaves[at])
        np.add.at(saved, parent[at], saved[at])
    columns = [depth, conv, pa.array(conv[parent], mask=parent < 0), n_convs, children, leaves, saved]
    taken = pa.array(by_slot)
    names = ["digest", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    return pa.table([shard["digest"].take(taken), shard["parent"].take(taken), *(pa.array(c) for c in columns)], names=names)


# --- the trie -----------------------------------------------------------------------------------------------------


def _ends(found: DataFrame) -> DataFrame:
    """(digest, ends_sha256): the ids of the conversations that end at a node, ascending, comma-joined and hashed.

    Ids are written in blocks of near ones first, so a node at which very many end is a few rows of a bounded length;
    the blocks then go through the hash one after the other.
    """
    blocks = found.where("left = 0").groupBy("digest", F.shiftright("conv_id", ID_BITS).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    texts = blocks.select("digest", "block", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    texts = texts.repartition("digest").sortWithinPartitions("digest", "block")

    def run(batches):
        node, state = None, None
        for batch in batches:
            done, hashes = [], []
            for digest, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if digest != node:
                    if node is not None:
                        done.append(node)
                        hashes.append(state.hexdigest())
                    node, state = digest, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary()), pa.array(hashes, pa.string())], names=["digest", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["digest", "ends_sha256"])

    return texts.mapInArrow(run, "digest binary, ends_sha256 string")


def trie(numbered: DataFrame, ids: DataFrame) -> DataFrame:
    """A row per node: digest, parent (its digest; the root's is null), depth, conv_id (the least member), parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens (characters) and ends_sha256.

    ``numbered`` has the turns (see ``turns``), ``ids`` the conversations; one without turns is a member of the root
    alone. No conversations give no nodes, not even a root. Two prefixes are one node if their digests (SHA-256) agree.
    """
    found = written(prefixes(numbered, ids), "prefixes")
    nodes = found.groupBy("digest", "parent", "depth", "chars").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("left") + 1).alias("below")
    )
    nodes = written(nodes, "nodes")
    # nodes by the power of two of the turns below them: the bound of a shard's subtrees, and what lies above
    sizes = {r["power"]: r["count"] for r in nodes.groupBy(F.floor(F.log2("below")).cast("int").alias("power")).count().collect()}
    power = SHARD_TURNS.bit_length() - 1
    while sum(n for p, n in sizes.items() if p >= power) > TOP_NODES:
        power += 1
    shards = max(1, -(-2 * sum(sizes.values()) >> power))
    heavy, light = nodes.where(F.floor(F.log2("below")) >= power), nodes.where(F.floor(F.log2("below")) < power)
    top = F.broadcast(heavy.select(F.col("digest").alias("over"), F.col("conv_id").alias("over_conv_id")))  # TOP_NODES at most

    # a light node's subtree is named by the first light prefix of any conversation that runs through it
    roots = found.join(top, found["digest"] == F.col("over"), "left_anti").groupBy("conv_id").agg(F.min(F.struct("depth", "digest")).alias("first"))
    placed = light.join(roots, "conv_id").withColumn("shard", F.pmod(F.xxhash64("first.digest"), F.lit(shards)))
    none = {c: F.lit(0).cast("long") for c in ("more_children", "more_leaves", "more_saved")}
    kept = ("digest", "parent", "depth", "chars", "conv_id", "n_convs", *none)
    shard = placed.withColumns(none).select("shard", *kept).groupBy("shard")
    low = shard.applyInArrow(_accumulated, _NODES)
    low = written(low.join(top, F.col("parent") == F.col("over"), "left").withColumn("cut", F.col("over").isNotNull()).drop("over"), "low-nodes")

    sums = low.where("cut").groupBy(F.col("parent").alias("digest")).agg(
        F.count(F.lit(1)).alias("more_children"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
    )
    above = heavy.join(sums, "digest", "left").fillna(0, list(none)).select(F.lit(0).alias("shard"), *kept)
    high = above.groupBy("shard").applyInArrow(_accumulated, _NODES)
    all_nodes = low.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "over_conv_id")).drop("over_conv_id", "cut").unionByName(high)
    nothing = hashlib.sha256(b"").hexdigest()
    return all_nodes.join(_ends(found), "digest", "left").select(
        "digest", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
