"""Exact removal of long repeats by suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere is removed. A
start of such a string is called a window. Equal windows are brought together in four steps,
of which only the last two see texts, and only the parts of them that can hold a repeat.

1. Equal texts form a class. Windows of a class of two or more are all repeated; one text of
   each class takes part in the rest.
2. Every window names an anchor: the place of the smallest hash among its ``GRAM``-byte strings,
   the leftmost of equal ones. Equal windows have the same anchor at the same distance, so
   windows whose anchor's string occurs once in the corpus are alone. A run is the windows next
   to each other that name one anchor.
3. Runs of anchors that occur twice or more are counted by a 128-bit digest of their windows.
   Runs of one digest repeat each other wholly, and one run of each kind goes on.
4. Anchors with several kinds of runs are dealt by their hash to buckets of about ``BUCKET``
   bytes. Each bucket's suffix array is built by two-stage sorting: suffixes smaller than their
   successor are sorted directly, all others are induced by one scan over the buckets of first
   bytes. Neighbours with a common prefix of ``LENGTH`` or more are repeats. An anchor of more
   than ``HOT`` kinds would outgrow a bucket; its kinds are compared window by window, by digests
   that are counted before they are shuffled.

Spans of a text are merged and cut out where the text is.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import slices, text_bytes, whole_text
from reviewlab.scale import BROADCAST_BYTES, cut_lineage, lookup_join, table_bytes

LENGTH = 200
GRAM = 64
BUCKET = 1 << 19
HOT = 4096
#: Bytes of text that anchors are searched in at once; places in them fit into PLACE bits.
CHUNK = 1 << 22
PLACE = np.uint64(32)


# ------------------------------------------------------------------------ anchors

def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a power of two) from each place on."""
    h = data.astype(np.uint64) + np.uint64(1)
    base, size = 0x9E3779B97F4A7C15, 1
    while size < gram:
        h = h[:-size] * np.uint64(base) + h[size:]
        h ^= h >> np.uint64(29)
        base, size = (base * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) & (2**64 - 1) | 1, size * 2
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of the ``width`` values from each place on."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def anchor_runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last): the runs of windows of one text and their anchors' hashes."""
    n = len(data) - length + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none, none
    hashes, firsts, lasts = [], [], []
    for low in range(0, n, CHUNK):
        high = min(n, low + CHUNK)
        h = gram_hashes(data[low:high + length - 1], gram)
        order = (h >> PLACE << PLACE) | np.arange(len(h), dtype=np.uint64)
        at = sliding_least(order, length - gram + 1) & np.uint64((1 << 32) - 1)
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        hashes.append(h[at[starts].astype(np.int64)])
        firsts.append(starts + low)
        lasts.append(np.concatenate([starts[1:], [len(at)]]) - 1 + low)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_text"):
        keys, made = [], ([], [], [])
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            runs = anchor_runs(np.frombuffer(text.as_py(), np.uint8))
            if len(runs[0]):
                keys.append(key.as_py())
                for out, x in zip(made, (runs[0].view(np.int64), runs[1].astype(np.int32), (runs[2] - runs[1]).astype(np.int32)), strict=True):
                    out.append(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(made[0], pa.list_(pa.int64())), pa.array(made[1], pa.list_(pa.int32())),
             pa.array(made[2], pa.list_(pa.int32()))], names=["_key", "hash", "first", "more"])


# ------------------------------------------------------------------- suffix arrays

def ascends(data: np.ndarray, depth: int) -> np.ndarray:
    """Whether the suffix at each place is smaller than its successor, or like it for ``depth`` bytes."""
    n = len(data)
    change = np.flatnonzero(data[1:] != data[:-1])
    up = np.zeros(n, bool)
    if not len(change):
        up[:max(0, n - depth)] = True
        return up
    following = np.searchsorted(change, np.arange(n))
    known = following < len(change)
    at = change[np.minimum(following, len(change) - 1)]
    up[known] = (data[at + 1] > data[at])[known]
    far = np.where(known, at, n - 1) - np.arange(n) >= depth
    return up | far


def suffix_order(buffer: bytes, first: np.ndarray, last: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Places first..last of all runs, sorted by the ``depth`` bytes from each on (two-stage sorting).

    The last place of every run has to ascend, and ``depth`` bytes have to follow it.
    """
    data = np.frombuffer(buffer, np.uint8)
    sizes = last - first + 1
    total = int(sizes.sum())
    begins = np.cumsum(sizes) - sizes
    place = np.arange(total) - np.repeat(begins, sizes) + np.repeat(first, sizes)
    heads = np.zeros(total, bool)
    heads[begins] = True
    up = ascends(data, depth)[place]
    byte = data[place]
    # Stage one: suffixes smaller than their successors, by comparison.
    direct = np.flatnonzero(up)
    keys = [buffer[p:p + depth] for p in place[direct].tolist()]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    del keys
    own = np.searchsorted(byte[direct], np.arange(257))
    # Stage two: one scan over the buckets; a suffix that was placed places its predecessor, if that is larger.
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []

    def predecessors(now: np.ndarray) -> np.ndarray:
        before = now[~heads[now]] - 1
        return before[~up[before]]

    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        bucket = []
        while len(wave):
            bucket.append(wave)
            before = predecessors(wave)
            wave = before[byte[before] == c]
        bucket.append(direct[own[c]:own[c + 1]])
        waiting[c] = []
        scanned = np.concatenate(bucket)
        order.append(scanned)
        before = predecessors(scanned)
        before = before[byte[before] > c]
        if len(before):
            before = before[np.argsort(byte[before], kind="stable")]
            edges = np.flatnonzero(np.concatenate([[True], byte[before][1:] != byte[before][:-1]]))
            for part in np.split(before, edges[1:]):
                waiting[byte[part[0]]].append(part)
    return place[np.concatenate(order)]


def common_prefix(buffer: bytes, a: np.ndarray, b: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Common prefix of the suffixes at ``a`` and ``b``, ``depth`` at most (a multiple of 8)."""
    words = np.ndarray((max(0, len(buffer) - 7),), "<u8", buffer, strides=(1,))
    common = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    for k in range(0, depth, 8):
        differ = words[a[open_] + k] ^ words[b[open_] + k]
        ended = differ != 0
        lowest = differ[ended] & (~differ[ended] + np.uint64(1))
        common[open_[ended]] = k + np.bitwise_count(lowest - np.uint64(1)) // 8
        open_ = open_[~ended]
    common[open_] = depth
    return common


def spans_of(starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Merged [begin, end) of the windows at the sorted ``starts``."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + length


def run_ends(data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each run, the end of the bytes that sort it.

    They hold the windows, and the next place from ``last`` on that ascends with the byte that shows it.
    """
    up = np.flatnonzero(ascends(data, LENGTH))
    change = np.flatnonzero(data[1:] != data[:-1])
    n = len(data)
    at = np.searchsorted(up, last)
    helper = up[np.minimum(at, max(0, len(up) - 1))] if len(up) else last
    k = np.searchsorted(change, helper)
    shown = np.where(k < len(change), change[np.minimum(k, max(0, len(change) - 1))] + 2, n) if len(change) else np.full(len(last), n)
    shown = np.minimum(shown, helper + LENGTH + 1)
    return np.minimum(n, np.where(at < len(up), np.maximum(last + LENGTH, shown), n))


def _batches_of(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _listed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("_key", "hash", "first", "more", "_text")), strict=True):
            yield tuple(x.as_py() for x in row)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run with its bytes."""
    def rows() -> Iterator[tuple]:
        for key, hashes, first, more, text in _listed_runs(batches):
            ends = run_ends(np.frombuffer(text, np.uint8), np.array(first) + np.array(more)).tolist()
            for h, f, m, e in zip(hashes, first, more, ends, strict=True):
                yield key, h, f, m, text[f:e]
    yield from _batches_of(rows(), ["_key", "hash", "first", "more", "bytes"], [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()])


def _run_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of the windows of each run."""
    from xxhash import xxh3_128_digest

    rows = ((key, h, f, m, xxh3_128_digest(text[f:f + m + LENGTH])) for key, hashes, first, more, text in _listed_runs(batches)
            for h, f, m in zip(hashes, first, more, strict=True))
    yield from _batches_of(rows, ["_key", "hash", "first", "more", "digest"], [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()])


def _window_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of each window of each run; ``hash`` of a run is passed on."""
    from xxhash import xxh3_128_digest

    rows = ((key, h, p, xxh3_128_digest(text[p:p + LENGTH])) for key, hashes, first, more, text in _listed_runs(batches)
            for h, f, m in zip(hashes, first, more, strict=True) for p in range(f, f + m + 1))
    yield from _batches_of(rows, ["_key", "hash", "first", "digest"], [pa.binary(), pa.int64(), pa.int32(), pa.binary()])


def repeats_in_bucket(contexts: list[bytes], more: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of the windows 0..more of each context that equal another one."""
    parts, first, last, at = [], [], [], 0
    for text, m in zip(contexts, more.tolist(), strict=True):
        data = np.frombuffer(text, np.uint8)
        up = np.flatnonzero(ascends(data[m:], length))
        # At the end of a text nothing may ascend any more: a byte above all closes the run.
        stop = m + int(up[0]) if len(up) else len(data) - 1
        parts.append(text + (b"" if len(up) else b"\xff") + bytes(length + 8))
        first.append(at)
        last.append(at + stop)
        at += len(parts[-1])
    buffer = b"".join(parts)
    first, last = np.array(first), np.array(last)
    order = suffix_order(buffer, first, last, length)
    owner = np.searchsorted(first, order, side="right") - 1
    offset = order - first[owner]
    real = offset <= more[owner]
    order, owner, offset = order[real], owner[real], offset[real]
    same = common_prefix(buffer, order[:-1], order[1:], length) >= length
    found = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(order) else np.zeros(0, bool)
    return owner[found], offset[found]


def _bucket_spans(table: pa.Table) -> pa.Table:
    """Repeated spans of the runs of one bucket.

    Runs alike in all bytes repeat each other wholly, and one of them stands for all in the
    suffix array, which holds the anchors of two or more different runs.
    """
    hashes, more = table.column("hash").to_pylist(), table.column("more").to_pylist()
    kinds: dict[tuple, list[int]] = {}
    for i, kind in enumerate(zip(hashes, table.column("bytes").to_pylist(), more, strict=True)):
        kinds.setdefault(kind, []).append(i)
    different = Counter(h for h, _, _ in kinds)
    sorted_ones = [kind for kind in kinds if different[kind[0]] > 1]
    found: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    if sorted_ones:
        owner, offset = repeats_in_bucket([k[1] for k in sorted_ones], np.array([k[2] for k in sorted_ones]))
        by_run = np.lexsort((offset, owner))
        owner, offset = owner[by_run], offset[by_run]
        edges = np.searchsorted(owner, np.arange(len(sorted_ones) + 1))
        found = {k: spans_of(offset[edges[i]:edges[i + 1]]) for i, k in enumerate(sorted_ones) if edges[i] < edges[i + 1]}
    keys, firsts = table.column("_key").to_pylist(), table.column("first").to_pylist()
    out: list[tuple] = []
    for kind, runs in kinds.items():
        if len(runs) > 1:
            out += [(keys[i], firsts[i], firsts[i] + kind[2] + LENGTH) for i in runs]
        elif kind in found:
            out += [(keys[runs[0]], firsts[runs[0]] + x, firsts[runs[0]] + y) for x, y in zip(*map(np.ndarray.tolist, found[kind]), strict=True)]
    columns = list(zip(*out, strict=True)) or [()] * 3
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("_key", "begin", "end"), columns, (pa.binary(), pa.int32(), pa.int32()), strict=True)})


# ----------------------------------------------------------------------- the whole

def _only(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Texts with one of the ``keys``, if these are few enough to be sent to all tasks; else all texts."""
    return texts.join(F.broadcast(keys), "_key", "left_semi") if table_bytes(keys) <= BROADCAST_BYTES else texts


def text_classes(body: DataFrame) -> DataFrame:
    """(_key, n, _first) of the texts that occur n >= 2 times."""
    return cut_lineage(body.groupBy("_key").agg(F.count("*").alias("n"), F.min("_row").alias("_first")).where("n > 1"))


def repeated_spans(body: DataFrame, classes: DataFrame) -> DataFrame:
    """(_key, spans): the repeated spans of every text of no class that holds some. Spans may overlap.

    ``body`` holds (_key, _text, _row): the MD5 of a text, its bytes, and a number that tells rows
    of a class apart; of those alike in it all take part, which changes no result.
    """
    marked = lookup_join(body, classes, ["_key"], ["_row"], "left")
    single = marked.where(F.col("n").isNull() | (F.col("_row") == F.col("_first"))).select("_key", "_text")
    anchors = cut_lineage(single.mapInArrow(_anchors, "_key binary, hash array<long>, first array<int>, more array<int>"))
    shared = cut_lineage(anchors.select(F.explode("hash").alias("hash")).groupBy("hash").agg(F.count("*").alias("_n")).where("_n > 1"))
    runs = anchors.select("_key", F.inline(F.arrays_zip("hash", "first", "more")))
    kept = lookup_join(runs, shared.select("hash"), ["hash"], ["_key", "first"], "left_semi")

    def with_texts(some: DataFrame) -> DataFrame:
        """One row per text with its runs; each text has one row on both sides."""
        lists = cut_lineage(some.groupBy("_key").agg(F.collect_list(F.struct("hash", "first", "more")).alias("r")).select(
            "_key", *[F.col(f"r.{c}").alias(c) for c in ("hash", "first", "more")]))
        return _only(single, lists.select("_key")).join(lists, "_key").select("_key", "hash", "first", "more", "_text")

    every = anchors.select("_key", F.lit(0).alias("begin"), F.lit(0).alias("end")).limit(0)
    # Runs alike in all windows repeat each other; one of each kind stands for them in what follows.
    digests = cut_lineage(with_texts(kept).mapInArrow(_run_digests, "_key binary, hash long, first int, more int, digest binary"))
    kinds = cut_lineage(digests.groupBy("hash", "digest").agg(F.count("*").alias("n"), F.min(F.struct("_key", "first", "more")).alias("one")))
    alike = lookup_join(digests, kinds.where("n > 1").select("digest"), ["digest"], ["_key", "first"], "left_semi")
    every = every.union(alike.select("_key", F.col("first").alias("begin"), (F.col("first") + F.col("more") + LENGTH).alias("end")))
    several = cut_lineage(kinds.groupBy("hash").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    ones = cut_lineage(lookup_join(kinds, several, ["hash"], ["digest"]).select("one.*", "hash", "n", "kinds"))
    usual = ones.where(F.col("kinds") <= HOT).select("_key", "hash", "first", "more")
    many = ones.where(F.col("kinds") > HOT).select("_key", "first", "more", F.col("n").alias("hash"))
    if not many.isEmpty():
        windows = cut_lineage(with_texts(many).mapInArrow(_window_digests, "_key binary, hash long, first int, digest binary"))
        twice = cut_lineage(windows.groupBy("digest").agg(F.count("*").alias("_n")).where("_n > 1").select("digest"))
        every = every.union(lookup_join(windows.where("hash = 1"), twice, ["digest"], ["_key", "first"], "left_semi").select(
            "_key", F.col("first").alias("begin"), (F.col("first") + LENGTH).alias("end")))
    size = usual.agg(F.sum(F.col("more") + LENGTH)).first()[0] or 0
    if size:
        contexts = with_texts(usual).mapInArrow(_contexts, "_key binary, hash long, first int, more int, bytes binary")
        buckets = F.pmod(F.xxhash64("hash"), F.lit(1 + size // BUCKET)).alias("_bucket")
        every = every.union(contexts.select(buckets, "_key", "hash", "first", "more", "bytes").groupBy("_bucket").applyInArrow(
            _bucket_spans, "_key binary, begin int, end int"))
    spans = every.join(F.broadcast(classes.select("_key")), "_key", "left_anti") if table_bytes(classes) <= BROADCAST_BYTES else \
        every.join(classes.select("_key"), "_key", "left_anti")
    return spans.groupBy("_key").agg(F.collect_set(F.struct("begin", "end")).alias("_spans"))


def merged(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Sorted spans without overlap, within ``size`` bytes."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted((s["begin"], min(size, s["end"])) for s in spans or []):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_text"):
        rows = []
        for text, spans in zip(batch.column("_text"), batch.column("_spans"), strict=True):
            data = text.as_py()
            runs = merged(spans.as_py(), len(data))
            kept = b"".join(data[a:b] for a, b in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(data)], strict=True))
            # Characters that lost some of their bytes go entirely from the text.
            rows.append((len(data), sum(e - s for s, e in runs), len(runs), hashlib.sha256(kept).hexdigest(),
                         kept.decode("utf-8", "ignore") if runs else data.decode("utf-8", "replace")))
        made = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [batch.column(i) for i in range(batch.num_columns - 2)] + [pa.array(m, k) for m, k in zip(made, kinds, strict=True)]
        names = batch.schema.names[:-2] + ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def remove_repeats(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row, n_bytes, n_removed, n_spans, kept_sha256 and kept_text.

    Matches never cross texts. A missing text is empty. Texts below LENGTH bytes and windows
    that occur once stay. All copies of a repeat are removed, in repeated rows as well. In
    kept_text characters that lost bytes are left out; kept_sha256 is over all kept bytes. An empty table
    gives no rows; other columns are not read.
    """
    ids = [f"_k{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(keep, ids, strict=True)], text_bytes(text).alias("_text"),
                     F.unhex(F.md5(whole_text(text))).alias("_key"), F.xxhash64(*keep).alias("_row"))
    body = rows.where(F.octet_length("_text") >= LENGTH).select("_key", "_text", "_row")
    classes = text_classes(body)
    spans = cut_lineage(repeated_spans(body, classes))
    marked = lookup_join(rows, classes.select("_key", "n"), ["_key"], ids, "left")
    # Only texts with spans meet them in a shuffle; a text that occurs twice goes as a whole, where it is.
    keys = spans.select("_key", F.lit(True).alias("_has"))
    if table_bytes(keys) <= BROADCAST_BYTES:
        marked = marked.join(F.broadcast(keys), "_key", "left")
    else:
        marked = marked.withColumn("_has", F.lit(True))
    whole = F.array(F.struct(F.lit(0).alias("begin"), F.lit(2**31 - 1).alias("end")))
    none = F.lit(None).cast("array<struct<begin:int,end:int>>")
    alone = marked.where(F.col("n").isNotNull() | F.col("_has").isNull()).select(
        *ids, "_text", F.when(F.col("n").isNotNull(), whole).otherwise(none).alias("_spans"))
    meeting = marked.where(F.col("n").isNull() & F.col("_has")).join(spans, "_key", "left").select(*ids, "_text", "_spans")
    kinds = [f"{k} {df.schema[c].dataType.simpleString()}" for c, k in zip(keep, ids, strict=True)]
    schema = ", ".join([*kinds, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"])
    out = alone.mapInArrow(_removed, schema).union(meeting.mapInArrow(_removed, schema))
    return out.withColumnsRenamed(dict(zip(ids, keep, strict=True)))
