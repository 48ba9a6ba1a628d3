"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

1. Every text gets a 64-bit fingerprint: the majority, bit by bit, of the XXH64 values of its
   3-word shingles.
2. Distinct fingerprints within ``DISTANCE`` differing bits agree on one of ``DISTANCE + 1``
   parts of the 64 bits, so they meet in a group keyed by the leading bits of that part.
   A group's key is as long as needed to hold about ``GROUP`` fingerprints.
3. Each group is indexed: its fingerprints are sorted by Gray rank, so that neighbours share
   many bits. A node of ``FANOUT`` neighbours holds the bits they all share; what the parent
   holds already is left out. A search goes down from the top, adds up the differences between
   the fingerprint and the shared bits, and leaves a whole node once they exceed ``DISTANCE``.
   All fingerprints of a group search at once. Links found become a spanning forest of the
   group, so a group of n near copies gives fewer than n links, not n * n.
4. Components of the links are found by alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import slices, text_bytes
from reviewlab.scale import cut_lineage, lookup_join

DISTANCE = 2
GROUP = 1024
FANOUT = 16
#: (search, node) pairs held at once.
PAIRS = 1 << 21


# ------------------------------------------------------------------ fingerprints

_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: bytes) -> int:
    """64 majority bits of the XXH64 values (seed 42) of the 3-word shingles of a text."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: only A-Z change, and only ASCII white space splits
    if not words:
        return 0
    if len(words) <= 3:
        return xxh64_intdigest(b" ".join(words), 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-3].tolist()]
    joined = b" ".join(words)
    hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, (ends[2:] - 1).tolist(), strict=True)], np.uint64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_text"):
        made = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["_id", "_fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _fp) of every row; the 64 bits of _fp are read as a signed number. An id is a number or binary."""
    kind = "binary" if df.schema[id_col].dataType.typeName() == "binary" else "long"
    rows = df.select(F.col(id_col).cast(kind).alias("_id"), text_bytes(text).alias("_text"))
    return rows.mapInArrow(_fingerprints, f"_id {kind}, _fp long")


# ------------------------------------------------------------- index of one group

def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit pattern in the reflected Gray order."""
    rank = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over sorted fingerprints, top first; the last level is the fingerprints."""

    def __init__(self, fps: np.ndarray, fanout: int = FANOUT):
        self.fps, self.fanout = fps, fanout
        every = np.full(len(fps), ~np.uint64(0))
        levels = [(every, fps)]
        while len(levels[-1][0]) > fanout:
            mask, value = levels[-1]
            starts = np.arange(0, len(mask), fanout)
            ones, zeros = np.bitwise_and.reduceat(value, starts), np.bitwise_or.reduceat(value, starts)
            shared = np.bitwise_and.reduceat(mask, starts) & ~(ones ^ zeros)
            levels.append((shared, ones & shared))
        self.levels = []
        above = np.zeros(1, np.uint64)
        for mask, value in reversed(levels):
            held = above[np.arange(len(mask)) // fanout] if self.levels else np.zeros(len(mask), np.uint64)
            self.levels.append((mask & ~held, value))
            above = mask

    def pairs(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs i < j of places with at most ``distance`` differing bits, in pieces.

        Searches that are still open wait on a stack in pieces of bounded size.
        """
        n, top, last = len(self.fps), len(self.levels[0][0]), len(self.levels) - 1
        wide = max(1, PAIRS // self.fanout)
        for low in range(0, n, wide):
            who = np.repeat(np.arange(low, min(n, low + wide)), top)
            stack = [(0, who, np.tile(np.arange(top), len(who) // top), np.zeros(len(who), np.uint8))]
            while stack:
                depth, who, node, differ = stack.pop()
                mask, value = self.levels[depth]
                # A pair is found from its later place alone: nodes that begin after it are left out.
                keep = node * self.fanout ** (last - depth) <= who
                who, node, differ = who[keep], node[keep], differ[keep]
                differ = differ + np.bitwise_count((self.fps[who] ^ value[node]) & mask[node])
                keep = differ <= distance
                who, node, differ = who[keep], node[keep], differ[keep]
                if depth == last:
                    yield node[node < who], who[node < who]
                    continue
                for k in range(0, len(who), wide):
                    part = slice(k, k + wide)
                    child = node[part, None] * self.fanout + np.arange(self.fanout)[None, :]
                    inside = child < len(self.levels[depth + 1][0])
                    stack.append((depth + 1, np.broadcast_to(who[part, None], child.shape)[inside], child[inside],
                                  np.broadcast_to(differ[part, None], child.shape)[inside]))


def forest(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (later, first) from each fingerprint to the first one of its component in the group."""
    fps = fps[np.argsort(gray_rank(fps), kind="stable")]
    parent = np.arange(len(fps))
    for a, b in GrayIndex(fps).pairs(distance):
        # Hook roots onto smaller roots and flatten, until both ends of every pair share a root.
        while True:
            ra, rb = parent[a], parent[b]
            open_pairs = ra != rb
            if not open_pairs.any():
                break
            a, b, ra, rb = a[open_pairs], b[open_pairs], ra[open_pairs], rb[open_pairs]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    moved = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[moved], fps[parent[moved]]


def _group_links(table: pa.Table) -> pa.Table:
    fps = table.column("_fp").combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64)
    a, b = forest(fps)
    return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})


# ---------------------------------------------------------- links and components

def _part(k: int, parts: int, bits: int) -> Column:
    """The leading ``bits`` of part ``k`` of the 64 bits."""
    low, high = 64 * k // parts, 64 * (k + 1) // parts
    used = min(bits, high - low)
    return F.shiftrightunsigned("_fp", high - used).bitwiseAND(F.lit((1 << used) - 1))


def links(distinct: DataFrame, held: int, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """(a, b) fingerprints that connect all those of ``distinct`` within ``distance`` bits.

    ``held`` is the number of distinct fingerprints; the groups' keys grow with it.
    """
    parts = distance + 1
    bits = max(1, (max(1, held) // group).bit_length())
    keys = F.array(*[F.struct(F.lit(k).alias("part"), _part(k, parts, bits).alias("key")) for k in range(parts)])
    spread = distinct.select("_fp", F.inline(keys))
    return spread.groupBy("part", "key").applyInArrow(_group_links, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link, root the least node of its component.

    Large-star links every larger neighbour of a node to its least one, small-star every
    smaller one; components stay and the trees get flat. The least neighbour is a plain
    aggregate, so a node of many links is combined before it is shuffled.
    """
    def star(now: DataFrame, large: bool) -> DataFrame:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else \
            now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(least, "a")
        moved = joined.where(F.col("b") > F.col("a")) if large else joined
        again = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            again = again.union(least.select("a", F.col("m").alias("b")))
        return again.where(F.col("a") != F.col("b")).distinct()

    now = cut_lineage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or not mark.n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        now = cut_lineage(star(star(now, True), False))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    Texts are linked if their fingerprints differ in at most ``distance`` bits; component_id is
    the smallest id that links reach, its own included. A missing or wordless text has the
    fingerprint zero and is linked like any other. Repeated rows and ids stay; a missing id is
    above every other one. An empty table gives no rows; other columns are not read.
    """
    rows = cut_lineage(fingerprints(df, id_col, text))
    distinct = cut_lineage(rows.groupBy("_fp").agg(F.min("_id").alias("_least")))
    pairs = links(distinct.select("_fp"), distinct.count(), distance)
    roots = components(pairs)
    rooted = distinct.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left").withColumn("root", F.coalesce("root", "_fp"))
    lowest = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    known = cut_lineage(rooted.join(lowest, "root").select("_fp", "component_id"))
    return lookup_join(rows, known, ["_fp"], ["_id"]).select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
