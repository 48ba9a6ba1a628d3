"""Compression distance: held-out accuracy, and rows of any kind."""

from __future__ import annotations

import random
import zlib

import numpy as np

from reviewlab.llm import toxicity as tx
from reviewlab.llm.queries import QUERIES


def made(n):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice(("the", "an", "er", "on", "ti", "re", "st", "ou")) for _ in range(rnd.randint(1, 4)))
    rows, marks = [], []
    for k in range(n):
        words = [word() for _ in range(rnd.randint(30, 200))]
        toxic = k % 4 == 0
        for _ in range(4 if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["grumpfick", "zwockel", "blafaxian"]))
        rows.append((k, " ".join(words), 1))
        marks.append((k, int(toxic)))
    return rows, marks


def test_held_out_rows_and_rows_of_any_kind(spark):
    rows, marks = made(900)
    rows += [(5000, None, 1), (5001, "", 1), (None, "text", 1), (5002, "word " * 30000, 1), (5003, "same", 1), (5003, "same", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([*marks, (5001, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    model = tx.fit(df, labels)
    got = tx.score_toxicity(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = dict(marks)
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.95 * len(held)
    assert tx.score_toxicity(df.limit(0), model).count() == 0
    empty = tx.fit(df, labels.limit(0))
    assert {r.predicted for r in tx.score_toxicity(df.limit(20), empty).collect()} == {0}


def test_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op3_compression_distance"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.75
