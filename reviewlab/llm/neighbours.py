"""Nearest neighbours by cosine, from stable projections in a kd-tree.

Unit vectors are projected onto ``M`` random directions of normal entries. For two vectors at
distance d the squared projected distance over d * d follows a chi-square distribution of M
degrees. So points are taken one after the other in order of projected distance r, as the leaves
of the kd-tree yield them, and verified on the original vectors; once r * r is over the
distribution's ``SURE`` quantile times the squared distance of the k-th best one, an unseen vector
that is nearer would have had a smaller r with that probability, and the search stops.

The upper levels of the tree are cut from the projections of a bounded sample and sent to the tasks;
every row is routed through them to its region, and each region has the box of all its rows. A query first searches the region it lies in, then, with the
k-th best of that, those other regions whose box the same test does not rule out. A region of more than
``BLOCK`` rows is dealt to several trees by hash, and the queries of a region come in chunks, so that no task
holds an unbounded group; the rows of a region move once per round for each ``CHUNK`` queries that visit it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlab.scale import cut_lineage, lookup_join

M = 16
SURE = 0.95
LEAF = 64
#: Points at most that are verified between two tests.
VERIFIED = 64
BLOCK = 8192
CHUNK = 8192
#: Rows, about, that the upper levels are cut from, and the fewest of them in a region.
SAMPLE = 100_000
LEAST_SAMPLED = 16
SEED = 42


def chi_square_quantile(p: float, degrees: int = M) -> float:
    """Quantile for an even number of degrees, by bisection of the closed form."""
    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))

    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return high


class KdTree:
    """Leaves of at most ``leaf`` points, split at the median of the widest side, with their boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.leaves: list[np.ndarray] = []
        open_ = [np.arange(len(points))]
        while open_:
            own = open_.pop()
            if len(own) <= leaf:
                self.leaves.append(own)
                continue
            side = int(np.argmax(np.ptp(points[own], axis=0)))
            own = own[np.argpartition(points[own, side], len(own) // 2)]
            open_ += [own[:len(own) // 2], own[len(own) // 2:]]
        self.low = np.array([points[x].min(axis=0) for x in self.leaves])
        self.high = np.array([points[x].max(axis=0) for x in self.leaves])

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of each leaf's box."""
        return np.square(np.maximum(0, np.maximum(self.low - point, point - self.high))).sum(axis=1)


class Regions:
    """Upper levels of a kd-tree: ``parts`` leaves, about, whose boxes fill the space of projections until they are drawn tight."""

    def __init__(self, points: np.ndarray, parts: int, least: int = LEAST_SAMPLED):
        most = max(least, -(-len(points) // max(parts, 1)))
        self.splits: list[tuple[int, float, int, int]] = []
        low, high = [], []
        #: Points, box and the place that waits for the node's number; leaves are numbered -1, -2, ...
        open_ = [(points, np.full(points.shape[1], -np.inf), np.full(points.shape[1], np.inf), None)]
        while open_:
            own, lower, upper, parent = open_.pop()
            cut, side = self._cut(own) if len(own) > most else (None, 0)
            number = -len(low) - 1 if cut is None else len(self.splits)
            if parent is not None:
                self.splits[parent[0]] = tuple(number if k == parent[1] else x for k, x in enumerate(self.splits[parent[0]]))
            if cut is None:
                low.append(lower)
                high.append(upper)
                continue
            self.splits.append((side, cut, 0, 0))
            below, above = upper.copy(), lower.copy()
            below[side] = above[side] = cut
            less = own[:, side] < cut
            open_ += [(own[~less], above, upper, (number, 3)), (own[less], lower, below, (number, 2))]
        self.low, self.high = np.array(low), np.array(high)

    @staticmethod
    def _cut(points: np.ndarray) -> tuple[float | None, int]:
        """A value of the widest side near its median with points below it; none if all points are alike."""
        side = int(np.argmax(np.ptp(points, axis=0)))
        values = np.sort(points[:, side])
        cut = values[len(values) // 2]
        if cut == values[0]:
            cut = values[min(int(np.searchsorted(values, cut, "right")), len(values) - 1)]
        return (None if cut == values[0] else float(cut)), side

    def route(self, points: np.ndarray) -> np.ndarray:
        """The number of the region that each point lies in."""
        out = np.zeros(len(points), np.int32)
        open_ = [(0, np.arange(len(points)))] if self.splits else []
        while open_:
            node, own = open_.pop()
            if node < 0:
                out[own] = -node - 1
            elif len(own):
                side, cut, below, above = self.splits[node]
                less = points[own, side] < cut
                open_ += [(below, own[less]), (above, own[~less])]
        return out

    def within(self, point: np.ndarray, bound: float) -> np.ndarray:
        """Regions whose box is no farther than ``bound``, a squared distance."""
        return np.flatnonzero(np.square(np.maximum(0, np.maximum(self.low - point, point - self.high))).sum(axis=1) <= bound)

    def tighten(self, boxes: Iterable[tuple[int, int, float, float]]) -> None:
        """Boxes of (region, side, least, largest) of all their rows; regions without rows are out of reach."""
        self.low, self.high = np.full_like(self.low, np.inf), np.full_like(self.high, -np.inf)
        for region, side, low, high in boxes:
            self.low[region, side], self.high[region, side] = low, high


def search(tree: KdTree, vectors: np.ndarray, norms: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int,
           projected: np.ndarray, k: int, quantile: float, floor: float = -math.inf) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores, verified): the k best rows found, best first, ties to the smaller id, and how many rows were verified.

    Leaves are opened in the order of their boxes; their points wait until no unopened box is nearer.
    ``floor`` is the k-th best score known from elsewhere.
    """
    far = tree.distances(projected)
    order = np.argsort(far, kind="stable")
    norm = math.sqrt(float((query * query).sum()))
    best_ids, best = np.empty(0, ids.dtype), np.empty(0)
    waiting, near = np.empty(0, np.int64), np.empty(0)
    at, opened, step, verified = 0, 2, 8, 0
    while True:
        # Squared distance of unit vectors; the floor is the rounding of equal ones.
        stop = reach(max(floor, best[-1]) if len(best) == k else floor, quantile)
        bound = far[order[at]] if at < len(order) else math.inf
        if len(waiting) and near[0] <= bound:
            ready = int(np.searchsorted(near[:step], min(bound, stop), "right"))
            if not ready:
                break
            rows, waiting, near = waiting[:ready], waiting[ready:], near[ready:]
            step, verified = min(2 * step, VERIFIED), verified + ready
            # Row by row, so that equal vectors have equal scores.
            scores = np.concatenate([best, (vectors[rows] * query).sum(axis=1) / (norms[rows] * norm)])
            every = np.concatenate([best_ids, ids[rows]])
            top = np.lexsort((every, -scores))[:k]
            best_ids, best = every[top], scores[top]
        elif at < len(order) and bound <= stop:
            rows = np.concatenate([tree.leaves[x] for x in order[at:at + opened]])
            at, opened = at + opened, min(2 * opened, 16)
            rows = rows[ids[rows] != query_id]
            every = np.concatenate([near, np.square(tree.points[rows] - projected).sum(axis=1)])
            sort = np.argsort(every, kind="stable")
            waiting, near = np.concatenate([waiting, rows])[sort], every[sort]
        else:
            break
    return best_ids, best, verified


def reach(kth: float, quantile: float) -> float:
    """Squared projected distance at which a search stops whose k-th best score is ``kth``."""
    return max(quantile * (2 - 2 * kth), 1e-9)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def _projected(vectors: np.ndarray, seed: int) -> np.ndarray:
    """Projections of the unit vectors, the same for equal vectors whatever stands next to them."""
    ways = np.random.default_rng(seed).standard_normal((vectors.shape[1], M))
    units = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    return np.stack([(units * way).sum(axis=1) for way in ways.T], axis=1)


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, row numbers, vectors) of a batch."""
    widths = batch.column("width").to_numpy()
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        yield int(width), own, _matrix(batch.column("vector").take(pa.array(own)), int(width))


def _sampled(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, own, vectors in _by_width(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), width, np.int32)), pa.array(_projected(vectors, seed).tolist(), pa.list_(pa.float64()))],
                                                 names=["width", "point"])
    return run


def _placer(regions: dict[int, Regions], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int32)
            for width, own, vectors in _by_width(batch):
                if width in regions:
                    out[own] = regions[width].route(_projected(vectors, seed))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "region"])
    return run


def _boxes(seed: int):
    """(width, region, side, low, high) of the rows of each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, own, vectors in _by_width(batch):
                kinds, at = np.unique(batch.column("region").to_numpy()[own], return_inverse=True)
                points = _projected(vectors, seed)
                low, high = np.full((len(kinds), M), np.inf), np.full((len(kinds), M), -np.inf)
                np.minimum.at(low, at, points)
                np.maximum.at(high, at, points)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(low.size, width, np.int32)), pa.array(np.repeat(kinds, M)),
                                                  pa.array(np.tile(np.arange(M, dtype=np.int32), len(kinds))), pa.array(low.ravel()), pa.array(high.ravel())],
                                                 names=["width", "region", "side", "low", "high"])
    return run


def _visitor(regions: dict[int, Regions], seed: int, quantile: float):
    """Each query once for every region but its own that its k-th best score does not rule out."""
    def cut(batch: pa.RecordBatch, rows: list[np.ndarray], found: list[np.ndarray]) -> pa.RecordBatch:
        taken = batch.take(pa.array(np.concatenate(rows)))
        return taken.set_column(taken.schema.get_field_index("region"), "region", pa.array(np.concatenate(found).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, floors = batch.column("region").to_numpy(), batch.column("floor").to_numpy()
            for width, own, vectors in _by_width(batch):
                rows, found, held = [], [], 0
                for row, point in zip(own, _projected(vectors, seed), strict=True) if width in regions else ():
                    near = regions[width].within(point, reach(floors[row], quantile))
                    near = near[near != home[row]]
                    rows, found, held = [*rows, np.full(len(near), row)], [*found, near], held + len(near)
                    if held > 4096:
                        yield cut(batch, rows, found)
                        rows, found, held = [], [], 0
                if held:
                    yield cut(batch, rows, found)
    return run


def _searcher(k: int, quantile: float, seed: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if points.num_rows and queries.num_rows:
            width = points.column("width")[0].as_py()
            vectors, wanted = _matrix(points.column("vector"), width), _matrix(queries.column("vector"), width)
            ids = points.column("id").to_numpy()
            norms = np.sqrt((vectors * vectors).sum(axis=1))
            tree, projected = KdTree(_projected(vectors, seed)), _projected(wanted, seed)
            for query, query_id, floor, point in zip(wanted, queries.column("id").to_numpy(), queries.column("floor").to_numpy(), projected, strict=True):
                found, scores, _ = search(tree, vectors, norms, ids, query, query_id, point, k, quantile, floor)
                out["query_id"] += [int(query_id)] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += scores.tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()),
                         "score": pa.array(out["score"], pa.float64())})
    return run


def usable(vector: Column) -> Column:
    """Vectors that are there, have finite parts only, and are not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def fit_regions(rows: DataFrame, n: int, block: int, sample: int, seed: int) -> dict[int, Regions]:
    """Upper levels for each length of vectors in a sample of about ``sample`` rows, of which projections alone are collected."""
    place = F.pmod(F.xxhash64(F.lit("sample"), "id", "vector"), F.lit(1 << 40)) / float(1 << 40)
    # Repeated ids share no draw with others, so that copies of a row cannot make the sample large.
    chosen = rows.where(place < sample / max(n, 1)).groupBy("id").agg(F.min(F.struct("width", "vector")).alias("x")).select("x.width", "x.vector")
    held: dict[int, list] = {}
    for r in sorted(chosen.mapInArrow(_sampled(seed), "width int, point array<double>").collect()):
        held.setdefault(r["width"], []).append(r["point"])
    total = sum(map(len, held.values()))
    return {w: Regions(np.array(x), -(-n * len(x) // (total * block))) for w, x in held.items()}


def draw_boxes(points: DataFrame, regions: dict[int, Regions], seed: int) -> None:
    """Boxes over all rows of each region; there are ``SAMPLE / LEAST_SAMPLED`` regions at most, whatever the table."""
    parts = points.mapInArrow(_boxes(seed), "width int, region int, side int, low double, high double")
    parts = parts.where(F.col("width").isin(*regions)) if regions else parts.limit(0)
    held: dict[int, list] = {w: [] for w in regions}
    for r in parts.groupBy("width", "region", "side").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        held[r["width"]].append(tuple(r)[1:])
    for width, boxes in held.items():
        regions[width].tighten(boxes)


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding",
            sure: float = SURE, seed: int = SEED, block: int = BLOCK, chunk: int = CHUNK, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest cosine found for each query row.

    A row is never its own neighbour, nor is one of its id. Vectors that are missing, zero or not
    finite, and rows without an id, take no part; vectors meet those of their own length only.
    Repeated rows are all candidates; a query id that occurs twice searches with its smallest
    vector. Ties go to the smaller id; fewer candidates give fewer rows; an empty table none.
    """
    quantile = chi_square_quantile(sure)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"),
                     is_query.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("width", F.size("vector"))
    regions = fit_regions(rows, rows.count(), block, sample, seed)
    placer = _placer(regions, seed)

    def placed(table: DataFrame) -> DataFrame:
        return table.select("id", "vector", "width").mapInArrow(placer, "id long, vector array<double>, width int, region int")

    points = placed(rows)
    draw_boxes(points, regions, seed)
    sizes = cut_lineage(points.groupBy("width", "region").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")))
    asked = placed(rows.where("asks").groupBy("id", "width").agg(F.min("vector").alias("vector"))).withColumn("floor", F.lit(float("-inf")))
    asked = cut_lineage(asked)

    def visit(asking: DataFrame) -> DataFrame:
        """(query_id, vec_id, score): the best of each tree of the region that a query asks."""
        where = ["width", "region"]
        loads = asking.groupBy(*where).agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
        loads = cut_lineage(sizes.join(loads, where))

        def dealt(table: DataFrame, part: str, copies: str) -> DataFrame:
            """Rows by their hash in one of ``part``, and one of each of ``copies``."""
            known = lookup_join(table, loads, where, ["id", "vector"])
            return known.withColumn(part[:-1], F.pmod(F.xxhash64(F.lit(part), "id", "vector"), F.col(part)).cast("int")).withColumn(
                copies[:-1], F.explode(F.sequence(F.lit(0), F.col(copies) - 1))).drop("parts", "chunks")

        keys = (*where, "part", "chunk")
        return dealt(points, "parts", "chunks").groupBy(*keys).cogroup(dealt(asking, "chunks", "parts").groupBy(*keys)).applyInArrow(
            _searcher(k, quantile, seed), "query_id long, vec_id long, score double")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = cut_lineage(best(visit(asked)))
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    again = asked.join(kth, "id", "left").select("id", "vector", "width", "region", F.coalesce("kth", "floor").alias("floor"))
    again = cut_lineage(again.mapInArrow(_visitor(regions, seed, quantile), again.schema))
    return best(first.drop("rank").unionByName(visit(again)))
