"""Shards of near equal bytes: the smallest feasible capacity over ordered, atomic groups.

Rows with equal texts form a group, which no cut divides. Groups are ordered by a digest of
the text, so a shard is a random mixture. The smallest capacity for which a greedy walk needs
no more than the given number of shards is found by bisection, and the groups are cut there.

The driver never sees the groups. It walks over the byte totals of at most 2**14 digest
ranges; a walk that would end inside a range of several groups marks it, marked ranges are
summed again in finer ranges (2**17 rows at most), and the search is repeated until no walk
ends inside a range. Then the capacity and the cuts are exactly those of the single groups.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlab.llm.common import whole_text
from reviewlab.scale import cut_lineage

KEY_BITS = 60
FIRST_BITS = 14
DETAIL = 1 << 17
OVERHEAD = 16
SLOT_ROWS = 20_000


class Range(NamedTuple):
    """Groups whose key, without its last ``shift`` bits, is ``prefix``."""

    shift: int
    prefix: int
    bytes: int
    groups: int


class Walk:
    """Greedy walks over the totals of ordered ranges; marks ranges a walk ends in."""

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges
        self.ends = list(accumulate(r.bytes for r in ranges))
        self.total = self.ends[-1] if ranges else 0
        self.marked: set[int] = set()

    def _mark(self, i: int) -> None:
        if i < len(self.ranges) and self.ranges[i].groups > 1:
            self.marked.add(i)

    def forward(self, start: int, capacity: int) -> int:
        """Number of ranges before the cut of a shard that begins after ``start`` ranges."""
        i = bisect_right(self.ends, (self.ends[start - 1] if start else 0) + capacity)
        self._mark(i)
        return i

    def backward(self, end: int, capacity: int) -> int:
        """Number of ranges before the first one of a shard that ends after ``end`` ranges."""
        least = (self.ends[end - 1] if end else 0) - capacity
        if least <= 0:
            return 0
        i = bisect_right(self.ends, least)
        self._mark(i)
        return i if i and self.ends[i - 1] == least else i + 1

    def feasible(self, capacity: int, shards: int) -> bool:
        at = 0
        for _ in range(shards):
            at = self.forward(at, capacity)
            if at == len(self.ranges):
                return True
        return False

    def capacity(self, shards: int) -> int:
        largest = max((r.bytes for r in self.ranges if r.groups == 1), default=0)
        low, high = max(-(-self.total // shards), largest), self.total
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.feasible(middle, shards) else (middle + 1, high)
        return low

    def cuts(self, shards: int) -> tuple[int, list[int]]:
        """Smallest capacity, and cuts that keep it: each as near to an equal share as it allows."""
        capacity, n = self.capacity(shards), len(self.ranges)
        least = [n]
        for _ in range(shards - 1):
            least.append(self.backward(least[-1], capacity))
        cuts, at = [], 0
        for k, low in enumerate(least[:0:-1], 1):
            high = self.forward(at, capacity)
            goal = self.total * k // shards
            i = bisect_right(self.ends, goal)
            self._mark(i)
            below, above = (self.ends[i - 1] if i else 0), (self.ends[i] if i < n else self.total)
            nearest = i if goal - below <= above - goal else min(i + 1, n)
            at = max(low, min(high, nearest), at)
            cuts.append(at)
        return capacity, cuts


def _sums(groups: DataFrame, shift: int) -> list[Range]:
    prefix = F.shiftright("_key", shift)
    rows = groups.groupBy(prefix.alias("p")).agg(F.sum("_bytes").alias("b"), F.count("*").alias("n")).collect()
    return [Range(shift, r.p, r.b, r.n) for r in rows]


def _finer(groups: DataFrame, walk: Walk) -> list[Range]:
    """The ranges of a walk, with each marked one replaced by its parts."""
    marked = [walk.ranges[i] for i in walk.marked]
    out = [r for i, r in enumerate(walk.ranges) if i not in walk.marked]
    held = sum(r.groups for r in marked)
    for shift in {r.shift for r in marked}:
        own = [r.prefix for r in marked if r.shift == shift]
        bits = shift if held <= DETAIL else max(1, (DETAIL // len(marked)).bit_length() - 1)
        out += _sums(groups.where(F.shiftright("_key", shift).isin(own)), max(0, shift - bits))
    return sorted(out, key=lambda r: r.prefix << r.shift)


def group_key(text: str = "text") -> Column:
    """The first 60 bits of the MD5 of the text."""
    return F.conv(F.substring(F.md5(whole_text(text)), 1, KEY_BITS // 4), 16, 10).cast("long")


def plan_shards(groups: DataFrame, shards: int) -> tuple[list[int], list[int], int]:
    """Keys that get a shard of their own, first keys of the other shards, and the capacity.

    ``groups`` holds (_key, _bytes). A group above the mean of what is left cannot share a
    shard of mean size, so it gets one; there are fewer of them than shards.
    """
    left, spare, own = groups.agg(F.sum("_bytes")).first()[0] or 0, shards, []
    for g in groups.orderBy(F.desc("_bytes"), "_key").limit(shards - 1).collect() if shards > 1 else []:
        if spare == 1 or g["_bytes"] * spare <= left:
            break
        own.append(g["_key"])
        left, spare = left - g["_bytes"], spare - 1
    rest = groups.where(~F.col("_key").isin(own)) if own else groups
    ranges = sorted(_sums(rest, KEY_BITS - FIRST_BITS), key=lambda r: r.prefix)
    while True:
        walk = Walk(ranges)
        capacity, cuts = walk.cuts(spare) if ranges else (0, [])
        if not walk.marked:
            break
        ranges = _finer(rest, walk)
    first = [ranges[c].prefix << ranges[c].shift if c < len(ranges) else 1 << KEY_BITS for c in cuts]
    return own, first, capacity


def shard_documents(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    Size is the UTF-8 bytes of the text plus 16. A missing text is an empty one and equal to
    it; missing and repeated ids are rows like any other. Slots are gapless within a shard,
    in order of a hash of the id; rows equal in key and id take either order. An empty table
    gives no rows. Other columns of ``df`` are not read.
    """
    body = whole_text(text)
    rows = cut_lineage(df.select(
        F.col(id_col), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), group_key(text).alias("_key")))
    groups = cut_lineage(rows.groupBy("_key").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows")))
    own, first, _ = plan_shards(groups, shards)
    past = reduce(lambda a, b: a + b, [(F.col("_key") >= k).cast("int") for k in first], F.lit(len(own)))
    shard = reduce(lambda at, k: F.when(F.col("_key") == k[1], F.lit(k[0])).otherwise(at), enumerate(own), past)
    # A shard may hold most rows: slots are counted per (shard, part), and parts are set one after the other.
    held = groups.agg(F.sum("_rows")).first()[0] or 0
    parts = max(8, held // (shards * SLOT_ROWS))
    placed = rows.withColumn("shard", shard.cast("int")).withColumn(
        "_part", F.pmod(F.xxhash64(id_col, "_key"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "_part").agg(F.count("*").alias("_n")).select(
        "shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_part").orderBy("_key", id_col)
    numbered = placed.withColumn("_at", F.row_number().over(inside)).join(offsets, ["shard", "_part"])
    return numbered.select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_before") + F.col("_at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
