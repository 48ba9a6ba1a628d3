"""Prefix trie of conversations as balanced parentheses.

Conversations are sorted by their turns and dealt out by ranges of that order, so each task holds a
contiguous part of the trie. A task cuts its part into shards of a bounded number of turns and writes
each as balanced parentheses: a node opens, its subtree follows, it closes. Then, for a node at place i,

* findclose(i), by minima of the excess over blocks of ``BLOCK`` signs and a tree above them, delimits its subtree;
* the number of leaf pairs ``()`` up to its close, less those before it, is its number of leaves;
* cumulative arrays over the opening signs give its members and what its subtree saves.

Nodes that lie on the path to a shard's first or last conversation may go on in the shard before or
after; their parts, a spine for each side of each shard, are added up by node. How far a neighbouring
task shares its spine is found from the first and last conversation of each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlab.scale import cut_lineage, lookup_join

STEP = 24  # bytes of a turn in a key: 16 of its digest, 8 of its size
BLOCK = 64
SHARD_TURNS = 1 << 18
PIECE_BYTES = 1 << 20
NUMBERS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
NOTHING = hashlib.sha256(b"").hexdigest()


# ------------------------------------------------------- balanced parentheses

class Parentheses:
    """A sequence of opening (True) and closing signs with minima of the excess over blocks."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1))
        pad = -len(opens) % BLOCK
        filled = np.concatenate([self.excess, np.full(pad, np.iinfo(np.int64).max)])
        self.levels = [filled.reshape(-1, BLOCK).min(axis=1)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            low = np.concatenate([low, np.full(len(low) % 2, np.iinfo(np.int64).max)])
            self.levels.append(np.minimum(low[::2], low[1::2]))

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The first place after each opening one where the excess is one less than there."""
        want, n = self.excess[at] - 1, len(self.opens)
        found = np.full(len(at), -1)
        place, left = at + 1, np.arange(len(at))
        # Inside the own block, sign by sign.
        for _ in range(BLOCK):
            hit = self.excess[np.minimum(place[left], n - 1)] <= want[left]
            found[left[hit]] = place[left[hit]]
            left = left[~hit]
            left = left[place[left] % BLOCK != BLOCK - 1]
            if not len(left):
                break
            place[left] += 1
        rest = np.flatnonzero(found < 0)
        if not len(rest):
            return found
        # Up the tree to the first block to the right that goes low enough, and down to it.
        node, level = at[rest] // BLOCK, np.zeros(len(rest), np.int64)
        going = np.arange(len(rest))
        for k, low in enumerate(self.levels):
            right = np.minimum(node[going] + 1, len(low) - 1)
            ok = (node[going] % 2 == 0) & (right > node[going]) & (low[right] <= want[rest[going]])
            node[going[ok]] += 1
            level[going[ok]] = k
            going = going[~ok]
            if not len(going):
                break
            node[going] //= 2
        for k in range(len(self.levels) - 1, 0, -1):
            down = np.flatnonzero(level == k)
            child = node[down] * 2
            node[down] = np.where(self.levels[k - 1][child] <= want[rest[down]], child, child + 1)
            level[down] = k - 1
        place = node * BLOCK
        going = np.arange(len(rest))
        for _ in range(BLOCK):
            hit = self.excess[np.minimum(place[going], n - 1)] <= want[rest[going]]
            found[rest[going[hit]]] = place[going[hit]]
            going = going[~hit]
            if not len(going):
                break
            place[going] += 1
        return found


class RangeMinimum:
    """Minima of any interval by two overlapping powers of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while (1 << len(self.rows)) <= len(values):
            low, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(low[:-half], low[half:]))

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Over first..last, both included."""
        out = np.empty(len(first), np.int64)
        power = np.frexp((last - first + 1).astype(float))[1] - 1
        for k in np.unique(power):
            at = np.flatnonzero(power == k)
            out[at] = np.minimum(self.rows[k][first[at]], self.rows[k][last[at] - (1 << int(k)) + 1])
        return out


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two keys share from the first one on."""
    n = min(len(a), len(b)) // STEP
    x, y = (np.frombuffer(k, np.uint8, n * STEP).reshape(n, STEP) for k in (a, b))
    differ = (x != y).any(axis=1)
    return int(differ.argmax()) if differ.any() else n


def trie_nodes(keys: list[bytes], shared: np.ndarray, counts: np.ndarray, least: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes, in order of their opening signs, of the trie of different sorted ``keys``.

    ``shared[j]`` are the turns that key j has in common with the one before; shared[0] those with the key before
    the shard, -1 without one, and shared[-1], one more, those of the last key with the one after.
    """
    depths = np.fromiter((len(k) // STEP for k in keys), np.int64, len(keys))
    held = np.concatenate([[-1], shared[1:-1]])
    new = depths - held
    closes = np.concatenate([depths[:-1] - held[1:], depths[-1:] + 1])
    # Signs: for each key its new nodes open, then those close that the next key does not share.
    lengths = np.empty(2 * len(keys), np.int64)
    lengths[::2], lengths[1::2] = new, closes
    opens = np.repeat(np.arange(len(lengths)) % 2 == 0, lengths)
    signs = Parentheses(opens)
    at = np.flatnonzero(opens)
    owner = np.repeat(np.arange(len(keys)), new)
    depth = signs.excess[at] - 1
    close = signs.findclose(at)
    rank = np.cumsum(opens)
    last = rank[close] - 1  # the last node that opens before this one closes
    n = len(at)
    # A node of its parent's depth that opened last before it.
    order = np.argsort(depth, kind="stable")
    spot = depth * (n + 1) + np.arange(n)
    parent = order[np.maximum(np.searchsorted(spot[order], (depth - 1) * (n + 1) + np.arange(n)) - 1, 0)]
    parent[0] = -1
    pairs = np.cumsum(opens & ~np.append(opens[1:], True))
    # Keys that end in a subtree: from the one that opened its top to the one that opened its last node.
    members = np.concatenate([[0], np.cumsum(counts)])
    n_convs = members[owner[last] + 1] - members[owner]
    # The last leaf goes on in the shard that follows if that one's first key begins with it.
    goes_on = shared[-1] >= depths[-1]
    leaves = pairs[close] - pairs[at] + (opens[at] & ~opens[at + 1])
    leaves -= (close == len(opens) - 1 - depth) & goes_on
    sizes = np.fromiter((int.from_bytes(keys[k][STEP * d - 8:STEP * d], "big") if d else 0
                         for k, d in zip(owner.tolist(), depth.tolist(), strict=True)), np.int64, n)
    before = (owner == 0) & (depth <= shared[0])
    saved = np.concatenate([[0], np.cumsum((n_convs - ~before) * sizes)])
    n_children = np.bincount(parent[1:][~before[1:]], minlength=n)
    after = (close == len(opens) - 1 - depth) & (depth <= shared[-1])
    return {"owner": owner, "depth": depth, "parent": parent, "n_convs": n_convs, "n_children": n_children,
            "n_leaves": leaves, "saved_tokens": saved[last + 1] - saved[np.arange(n)],
            "conv_id": RangeMinimum(least)(owner, owner[last]), "shared": before | after,
            "ends": depth == depths[owner]}


# ------------------------------------------------------------ shards of a task

#: What a task hands on: kind 0 whole nodes, 1 parts of nodes on a spine, 2 pieces of the ids that end at a node on it.
SCHEMA = ("kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
          "saved_tokens long, ends_sha256 string, node binary, above binary, ids string, first_id long")


def name_of(key: bytes, depth: int) -> bytes:
    return hashlib.md5(key[:STEP * depth]).digest()


class Shards:
    """Builds the shards of one task from its sorted rows."""

    def __init__(self, before: int, after: int, same_before: bool, goes_on: bytes | None):
        self.after, self.same_before, self.goes_on = after, same_before, goes_on
        self.keys: list[bytes] = []
        self.shared: list[int] = [before]
        self.counts: list[int] = []
        self.least: list[int] = []
        self.ends: list[str | None] = []
        self.turns = 0
        self.first = True

    def open_class(self, key: bytes) -> Iterator[pa.RecordBatch]:
        """A new key; a shard that is full is handed on first."""
        if self.keys:
            yield from self.close_class()
            common = common_turns(self.keys[-1], key)
            if self.turns >= SHARD_TURNS:
                yield from self.flush(common)
                self.shared = [common]
            else:
                self.shared.append(common)
        self.keys.append(key)
        self.counts.append(0)
        self.least.append(0)
        self.turns += len(key) // STEP + 1
        # Ids that may stand in several tasks are handed on in pieces, others are hashed as they come.
        self.split = (self.first and self.same_before) or (self.goes_on == name_of(key, len(key)) if self.goes_on else False)
        self.first = False
        self.hash, self.piece, self.begin = hashlib.sha256(), [], None
        self.held = 0

    def add(self, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Ids of the open key, ascending."""
        if not self.counts[-1]:
            self.least[-1] = int(ids[0])
        text = ",".join(map(str, ids.tolist()))
        if self.split:
            self.begin = int(ids[0]) if self.begin is None else self.begin
            self.piece.append(text)
            self.held += len(text)
            if self.held >= PIECE_BYTES:
                yield from self.hand_on()
        else:
            self.hash.update((("," if self.counts[-1] else "") + text).encode())
        self.counts[-1] += len(ids)

    def hand_on(self) -> Iterator[pa.RecordBatch]:
        if self.piece:
            key = self.keys[-1]
            yield rows({"kind": [2], "node": [name_of(key, len(key) // STEP)], "ids": [",".join(self.piece)], "first_id": [self.begin]})
        self.piece, self.begin, self.held = [], None, 0

    def close_class(self) -> Iterator[pa.RecordBatch]:
        yield from self.hand_on()
        self.ends.append(None if self.split else self.hash.hexdigest())

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            yield from self.close_class()
            yield from self.flush(self.after)

    def flush(self, common: int) -> Iterator[pa.RecordBatch]:
        made = trie_nodes(self.keys, np.array([*self.shared, common]), np.array(self.counts), np.array(self.least))
        parent, shared = made["parent"], made["shared"]
        owner, depth, ends = made["owner"].tolist(), made["depth"].tolist(), made["ends"].tolist()
        inside = (parent >= 0) & ~shared[parent]
        above = [name_of(self.keys[k], d - 1) if d and not i else None for k, d, i in zip(owner, depth, inside.tolist(), strict=True)]
        node = [name_of(self.keys[k], d) if s else None for k, d, s in zip(owner, depth, shared.tolist(), strict=True)]
        digests = [self.ends[k] if e else None if s else NOTHING for k, e, s in zip(owner, ends, shared.tolist(), strict=True)]
        yield rows({
            "kind": shared.astype(np.int32), "conv_id": made["conv_id"], "depth": made["depth"],
            "parent_conv_id": pa.array(made["conv_id"][parent], pa.int64(), mask=~inside),
            **{c: made[c] for c in NUMBERS},
            "ends_sha256": digests, "node": node, "above": above})
        self.keys, self.counts, self.least, self.ends, self.turns = [], [], [], [], 0


ARROW = pa.schema([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]])
                   for f in SCHEMA.split(", ")])


def rows(columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns and not isinstance(columns[f.name], pa.Array)
                            else columns.get(f.name, pa.nulls(n, f.type)) for f in ARROW], schema=ARROW)


def build_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shards, current = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = batch.column("key"), batch.column("conv_id").to_numpy(zero_copy_only=False)
        if shards is None:
            first = {c: batch.column(c)[0].as_py() for c in ("before", "after", "same_before", "goes_on")}
            shards = Shards(**first)
        keys = keys.to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if keys[start] != current:
                    current = keys[start]
                    yield from shards.open_class(current)
                yield from shards.add(ids[start:i])
                start = i
    if shards:
        yield from shards.finish()


SIDES = pa.schema({"part": pa.int32(), "before": pa.int32(), "after": pa.int32(), "same_before": pa.bool_(), "goes_on": pa.binary()})


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each task, in their order: the turns that it shares with the one before and after it, and the name of a last key that goes on."""
    last = None

    def out(row: dict, following: bytes | None) -> pa.RecordBatch:
        after = -1 if following is None else common_turns(row["high"], following)
        goes_on = name_of(row["high"], len(row["high"])) if following == row["high"] else None
        made = {"part": row["part"], "before": row["before"], "after": after, "same_before": row["same"], "goes_on": goes_on}
        return pa.RecordBatch.from_pylist([made], SIDES)

    for batch in batches:
        for row in batch.to_pylist():
            if last:
                yield out(last, row["low"])
            row["before"] = common_turns(last["high"], row["low"]) if last else -1
            row["same"] = bool(last) and last["high"] == row["low"]
            last = row
    if last:
        yield out(last, None)


def hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the pieces of each node, which come together and in order."""
    node, digest = None, None
    for batch in batches:
        for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if name != node:
                if node is not None:
                    yield pa.record_batch([[node], [digest.hexdigest()]], ["node", "hashed"])
                node, digest = name, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if node is not None:
        yield pa.record_batch([[node], [digest.hexdigest()]], ["node", "hashed"])


# ------------------------------------------------------------------- operator

def rebuild(df: DataFrame, family: int, heads: int, id_col: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """(conv_id, key) of every conversation c after its first h turns gave way to those of conversation c - c % family.

    h is crc32(c) % heads. A key holds, for each turn, an MD5 of role and text, and the bytes of the text.
    """
    whole = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    role_, text_ = whole(role), whole(text)
    # Role and text of different lengths cannot run into each other.
    digest = F.md5(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_))
    base = (F.col("conv_id") - F.col("conv_id") % family).alias("base")
    turns = df.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), digest.alias("digest"),
        F.lpad(F.hex(F.octet_length(text_)), 16, "0").alias("size"))
    # One exchange by family serves the grouping by conversation and the window over its family.
    own = turns.withColumn("base", base).repartition("base").groupBy("base", "conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "digest", "size"))).alias("turns"))
    steps = own.select("base", "conv_id", F.transform("turns", lambda t: F.concat(t["digest"], t["size"])).alias("steps"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    # Of a conversation that heads a family no more than heads - 1 turns are ever taken.
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.array_join(F.slice("steps", 1, heads - 1), ""))).over(Window.partitionBy("base"))
    cut = steps.withColumn("head", F.coalesce(head, F.lit("")))
    rest = F.array_join(F.slice("steps", h + 1, F.greatest(F.size("steps"), F.lit(1))), "")
    return cut.select("conv_id", F.unhex(F.concat(F.substr("head", F.lit(1), h * (2 * STEP)), rest)).alias("key"))


def prefix_trie(keys: DataFrame) -> DataFrame:
    """Nodes of the trie of (conv_id, key), as the query's contract names them.

    Rows of one key with equal ids count as so many members. A key of no turns is a member of the root only.
    No rows give no nodes, not even the root.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = keys.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    placed = cut_lineage(placed.withColumn("part", F.spark_partition_id()))
    # One row per task that has rows.
    edges = placed.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    edges = edges.coalesce(1).sortWithinPartitions("part")
    sides = edges.mapInArrow(neighbours, "part int, before int, after int, same_before boolean, goes_on binary")
    known = placed.join(F.broadcast(sides), "part")
    made = cut_lineage(known.select("key", "conv_id", "before", "after", "same_before", "goes_on").mapInArrow(build_shards, SCHEMA))

    added = [F.sum(c).alias(c) for c in NUMBERS]
    pieces = made.where("kind = 2").select("node", "ids", "first_id")
    hashed = pieces.repartition("node").sortWithinPartitions("node", "first_id").mapInArrow(hash_pieces, "node binary, hashed string")
    spines = made.where("kind = 1").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.max("above").alias("above"), *added,
        F.max("ends_sha256").alias("ends_sha256"))
    digest = F.coalesce("hashed", "ends_sha256", F.lit(NOTHING)).alias("ends_sha256")
    spines = cut_lineage(spines.join(hashed, "node", "left").select("node", "above", "conv_id", "depth", *NUMBERS, digest))
    parents = spines.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    whole = made.where("kind = 0")
    inside = whole.where("above IS NULL").select("conv_id", "depth", "parent_conv_id", *NUMBERS, "ends_sha256")
    below = whole.where("above IS NOT NULL").select("above", "conv_id", "depth", *NUMBERS, "ends_sha256").unionByName(spines.drop("node"))
    found = lookup_join(below, parents, ["above"], ["above", "conv_id", "depth"], "left")
    return inside.unionByName(found.select(*inside.columns))
