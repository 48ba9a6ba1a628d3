"""Projected neighbours: exact scores, recall against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from reviewlab.llm.neighbours import KdTree, M, Regions, _projected, chi_square_quantile, nearest, reach, search
from reviewlab.llm.queries import QUERIES
from tests.conftest import SMALL


def brute(rows, asks, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if asks(q):
            scored = sorted(((-(a * b).sum() / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum())), i) for i, b in good
                             if i != q and len(a) == len(b)))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def compare(got, want, recall):
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert {q for q, v in want.items() if v} == set(found)
    hit = total = 0
    for q, rows in found.items():
        assert sorted(rows) == list(range(1, len(want[q]) + 1))
        ordered = [rows[k] for k in sorted(rows)]
        assert ordered == sorted(ordered, key=lambda x: (-x[1], x[0]))
        least = want[q][-1][1]
        hit += sum(s >= least - 1e-12 for _, s in ordered)
        total += len(ordered)
    assert hit >= recall * total


def test_quantile():
    assert abs(chi_square_quantile(0.95, 2) - 5.991) < 0.01 and abs(chi_square_quantile(0.95, 8) - 15.507) < 0.01


def test_leaves_hold_every_point_once():
    points = np.random.default_rng(1).standard_normal((1000, 4))
    points[:500] = points[0]
    tree = KdTree(points, 16)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(1000)) and max(map(len, tree.leaves)) <= 16
    q = np.zeros(4)
    for d, leaf in zip(tree.distances(q), tree.leaves, strict=True):
        assert (np.square(points[leaf]).sum(axis=1) >= d - 1e-12).all()


def test_rows_of_any_kind(spark):
    rnd = random.Random(4)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(6)]
    rows = [(k, vec()) for k in range(300)]
    same = vec()
    rows += [(1000 + k, same) for k in range(400)] + [(50, same), (None, vec()), (2000, None), (2001, [0.0] * 6), (2002, [float("nan")] * 6),
             (2003, [float("inf")] + [1.0] * 5), (2004, [None] + [1.0] * 5), (2005, []), (2050, [1.0, 2.0]), (2100, [2.0, 4.0]), (2150, [3.0])]
    rows = [r for r in rows if r != (50, rows[50][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    want = brute(rows, lambda q: q % 50 == 0)
    compare(nearest(df, F.col("vec_id") % 50 == 0, block=64, chunk=5).collect(), want, 1.0 if len(rows) < 64 else 0.95)
    ids = {r.query_id: [] for r in nearest(df, F.col("vec_id") == 1000).collect()}
    for r in nearest(df, F.col("vec_id") == 1000).orderBy("rank").collect():
        ids[r.query_id].append(r.vec_id)
    assert ids == {1000: [50, 1001, 1002, 1003, 1004]}
    assert nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_query_has_the_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    compare(QUERIES["op7_stable_projection_neighbours"](spark, SMALL).collect(), brute(rows, lambda q: q % 50 == 0), 0.9)


def verified_share(vectors, asks, k=5):
    """Share of all rows that searches verify, and their recall."""
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    units = vectors / norms[:, None]
    ways = np.random.default_rng(42).standard_normal((vectors.shape[1], M))
    tree, ids, quantile = KdTree(units @ ways), np.arange(len(vectors)), chi_square_quantile(0.95)
    seen = hit = 0
    for q in asks:
        found, scores, verified = search(tree, vectors, norms, ids, vectors[q], q, units[q] @ ways, k, quantile)
        cosines = np.delete(units @ units[q], q)
        hit += int((scores >= np.sort(cosines)[-k] - 1e-12).sum())
        seen += verified
        assert len(found) == k and q not in found
    return seen / len(asks) / len(vectors), hit / len(asks) / k


def test_share_of_rows_verified(spark):
    rnd = np.random.default_rng(5)
    clusters = rnd.standard_normal((40, 64)).repeat(100, axis=0) + 0.3 * rnd.standard_normal((4000, 64))
    share, recall = verified_share(clusters, range(0, 4000, 50))
    assert share < 0.1 and recall >= 0.9
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").where("embedding IS NOT NULL").orderBy("vec_id").collect()
    share, recall = verified_share(np.array([r.embedding for r in rows], float), range(0, len(rows), 5))
    assert share < 0.9 and recall >= 0.9


def test_regions_hold_every_point_in_its_box():
    points = np.random.default_rng(2).standard_normal((2000, 4))
    points[:700] = points[0]
    points[700:900, 0] = 0.0
    regions = Regions(points, 20)
    at = regions.route(points)
    assert len(regions.low) >= 10 and (regions.low[at] <= points).all() and (points <= regions.high[at]).all()
    assert set(at.tolist()) <= set(range(len(regions.low))) and len(set(at[:700].tolist())) == 1
    assert len(Regions(np.ones((500, 4)), 20).low) == 1 and Regions(np.ones((500, 4)), 20).route(np.zeros((3, 4))).tolist() == [0, 0, 0]
    far = points[5] + 3.0
    assert set(regions.within(far, np.inf)) == set(range(len(regions.low)))
    near = set(regions.within(far, 4.0).tolist())
    assert all(int(r) in near for r, x in zip(at, points, strict=True) if np.square(x - far).sum() <= 4.0)


def test_clusters_over_regions(spark):
    """With many small regions and few rows sampled: recall, whole ranks, and regions that the bound rules out."""
    rnd = np.random.default_rng(5)
    vectors = rnd.standard_normal((40, 64)).repeat(50, axis=0) + 0.3 * rnd.standard_normal((2000, 64))
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, lambda q: q % 50 == 0)
    compare(nearest(df, F.col("vec_id") % 50 == 0, block=128, chunk=7, sample=600).collect(), want, 0.9)
    points, quantile, share = _projected(vectors, 42), chi_square_quantile(0.95), []
    for parts in (16, 64):
        regions = Regions(points, parts)
        at = regions.route(points)
        regions.tighten((r, k, points[at == r, k].min(), points[at == r, k].max()) for r in set(at.tolist()) for k in range(M))
        visits = [len(regions.within(points[q], reach(want[q][-1][1], quantile))) for q in want]
        share.append(np.mean(visits) / len(regions.low))
    assert share[1] < 0.4 and share[1] < 0.7 * share[0]
