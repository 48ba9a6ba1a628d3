"""Shards, licences and mixing: rows of any kind, SQL, and brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from checks.compare import differences, open_tables
from reviewlab.llm import sharding
from reviewlab.llm.licences import scan_licences
from reviewlab.llm.mixing import mix_sources
from reviewlab.llm.queries import QUERIES, SQL
from reviewlab.llm.sharding import Range, Walk, shard_documents
from tests.conftest import SMALL


@pytest.mark.parametrize("seed", range(30))
def test_smallest_capacity_and_cuts(seed):
    rnd = random.Random(seed)
    sizes = [rnd.randint(1, 50) for _ in range(rnd.randint(1, 40))]
    shards = rnd.randint(1, 8)
    best = [0] + [10**9] * len(sizes)
    for _ in range(shards):
        best = [min(max(best[j], sum(sizes[j:i])) for j in range(i + 1)) for i in range(len(sizes) + 1)]
    capacity, cuts = Walk([Range(0, i, s, 1) for i, s in enumerate(sizes)]).cuts(shards)
    edges = [0, *cuts, len(sizes)]
    assert capacity == best[-1] and edges == sorted(edges) and len(cuts) == shards - 1
    assert max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:], strict=False)) <= capacity


def check_shards(rows, got, shards):
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    texts, slots, total = defaultdict(set), defaultdict(list), Counter()
    by_crc = {zlib.crc32((r[1] or "").encode()): r[1] or "" for r in rows}
    for r in got:
        text = by_crc[r.text_crc32]
        assert r.size == len(text.encode()) + 16 and r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        texts[text].add(r.shard)
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
    assert all(len(s) == 1 for s in texts.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return total


def test_shards_of_rows_of_any_kind(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 2)
    monkeypatch.setattr(sharding, "DETAIL", 16)
    rows = [(k, "word " * (k % 30), 1) for k in range(300)] + [(1000 + k, "the same text " * 9, 1) for k in range(200)]
    rows += [(None, None, 1), (7, "", 1), (7, "", 1), (2000, "long " * 5000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int")
    assert len(check_shards(rows, shard_documents(df, 5).collect(), 5)) == 5
    assert shard_documents(df.limit(0), 5).count() == 0


def test_shards_of_the_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    total = check_shards(rows, QUERIES["op5_minimax_shards"](spark, SMALL).collect(), 40)
    assert max(total.values()) <= max(sum(total.values()) / 40, 0) + max(len(t.encode()) + 16 for _, t in rows)


def test_licences_of_rows_of_any_kind(spark):
    line = "Released under the MIT License."
    rows = [(1, None, 1), (2, "", 1), (3, "text\n" + line.upper() + "\nmore", 1), (4, "Released under\nthe MIT Licence", 1), (4, "word " * 50000, 1),
            (None, "a\n\nreleased under the MIT\nlicense\n\nb", 1), (5, "the MIT of nothing", 1), (6, (line + "\n") * 3, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, dice int")
    # A line that lacks the last word has a Dice value of 6 / 7: it matches beside its paragraph.
    got = Counter((r.doc_id, r.licence, r.n_matches) for r in scan_licences(df).collect())
    assert got == Counter([(1, None, 0), (2, None, 0), (3, "MIT", 1), (4, "MIT", 1), (4, None, 0), (None, "MIT", 2), (5, None, 0), (6, "MIT", 3)])
    assert scan_licences(df.limit(0)).count() == 0


def test_mixing_of_rows_of_any_kind(spark):
    rows = [(k, "t", "big", 5) for k in range(3000)] + [(5000 + k, None, None, 5) for k in range(300)] + [(None, "x", "one", 5), (1, "", "one", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_copies int")
    got = mix_sources(df, {"big": 1, None: 1, "one": 2, "absent": 0}, total=40000).collect()
    n = Counter(r.source for r in got)
    assert abs(n["big"] - 10000) < 500 and abs(n[None] - 10000) < 500 and abs(n["one"] - 20000) < 800
    copies = defaultdict(list)
    for r in got:
        copies[(r.doc_id, r.source)].append((r.copy_no, r.n_copies))
    assert all(sorted(c) == [(k, len(c)) for k in range(len(c))] for c in copies.values())
    assert mix_sources(df.limit(0)).count() == 0


def test_rows_without_an_id_of_their_own_draw_one_by_one(spark):
    """Missing and repeated ids, equal rows and clashing names: draws are those of single rows, and keys differ."""
    same = [(None, "same", "a", 1.0)] * 3000 + [(7, "same", "a", 1.0)] * 3000
    rows = same + [(None, str(k), "a", 1.0) for k in range(3000)] + [(8, str(k), "a", 1.0) for k in range(3000)] + [(9, "x", "a", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _source string, _who double").withColumn("source", F.lit("a"))
    got = mix_sources(df, total=2 * len(rows)).collect()
    for kind in (lambda r: r.doc_id is None and r.text == "same", lambda r: r.doc_id == 7, lambda r: r.doc_id is None and r.text != "same", lambda r: r.doc_id == 8):
        own = [r for r in got if kind(r)]
        assert abs(len(own) - 6000) < 400 and abs(sum(r.copy_no == 0 for r in own) - 3000 * (1 - math.exp(-2))) < 120
    keys = Counter(r.order_key for r in got)
    assert max(keys.values()) == 1 and got[0].asDict().keys() >= set(df.columns)
    assert Counter(mix_sources(df.repartition(3), total=2 * len(rows)).collect()) == Counter(got)
    alone = mix_sources(df.where("doc_id = 9").withColumn("source", F.lit("b")).unionByName(df.where("doc_id = 9")), {"b": 1}, total=5).collect()
    assert {r.source for r in alone} <= {"b"}


@pytest.mark.parametrize("name", ["op9_licence_scan", "op10_poisson_mixing"])
def test_queries_against_sql(spark, name):
    assert differences(spark, open_tables(SMALL), SMALL, QUERIES[name], SQL[name]) == ""
