"""Sums over tokens, in place and by a join, and the plans they give."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlab.operators import token_sums
from reviewlab.operators.models import score_labels
from reviewlab.operators.similarity import with_word_vector_cosine
from reviewlab.plans.jobs import score_pairs


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_sums_of_vectors(spark, monkeypatch, limit):
    monkeypatch.setattr(token_sums, "CELLS", 7)
    rnd = random.Random(2)
    vecs = {f"w{k}": [rnd.gauss(0, 1) for _ in range(3)] for k in range(20)}
    table = [(w, v) for w, v in vecs.items()] + [("w3", [1.0, 1.0, 1.0]), ("none", None), (None, [9.0] * 3)]
    rows = [(k, [f"w{rnd.randrange(25)}" for _ in range(rnd.randint(0, 30))], [rnd.choice(["x", "w1", None, "none"]) for _ in range(3)], {"k": k}) for k in range(50)]
    rows += [(50, None, [], None)]
    df = spark.createDataFrame(rows, "review_id long, a array<string>, b array<string>, m map<string,int>").repartition(3)
    vectors = spark.createDataFrame(table, "word string, vec array<float>")
    got = token_sums.with_token_sums(df, vectors, {"sa": F.col("a"), "sb": F.col("b")}, limit=limit, tasks=3)
    assert got.columns == [*df.columns, "sa", "sb"]
    vecs["w3"] = [x + 1.0 for x in vecs["w3"]]
    vecs["none"] = [0.0] * 3
    out = {r.review_id: r for r in got.collect()}
    assert len(out) == 51 and out[7].m == {"k": 7}
    for k, a, b, _ in rows:
        for tokens, s in ((a, out[k].sa), (b, out[k].sb)):
            known = [vecs[t] for t in tokens or [] if t in vecs]
            assert s == (pytest.approx(np.sum(known, axis=0), abs=1e-5) if known else None)


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_vectors_of_many_dimensions(spark, limit):
    spark.conf.set("spark.sql.codegen.maxFields", "100")
    try:
        vectors = spark.range(30).select(F.concat(F.lit("w"), "id").alias("word"), F.transform(
            F.sequence(F.lit(1), F.lit(768)), lambda i: (i * (F.col("id") + 1) % 7).cast("float")).alias("vec"))
        df = spark.range(40).select(F.col("id").alias("review_id"), F.array(F.concat(F.lit("w"), F.col("id") % 30)).alias("a"),
                                    F.array(F.lit("w1"), F.lit("w2"), F.lit("w2")).alias("b"))
        vecs = {r.word: np.array(r.vec, float) for r in vectors.collect()}
        got = with_word_vector_cosine(df, vectors, {"a": F.col("a"), "b": F.col("b")}, {"c": ("a", "b")}, limit=limit)
        both = vecs["w1"] + 2 * vecs["w2"]
        for r in got.collect():
            a = vecs[f"w{r.review_id % 30}"]
            norm = np.linalg.norm(a) * np.linalg.norm(both)
            assert r.c == pytest.approx(a @ both / norm if norm else 0.0)
    finally:
        spark.conf.set("spark.sql.codegen.maxFields", "400")


def test_labels_without_a_lexicon(spark):
    df = spark.createDataFrame([(1, "a")], "review_id long, t string")
    empty = spark.createDataFrame([], "label string, token string, weight double")
    assert score_labels(df, {"s": "t"}, empty).first().s == []


def test_scores_read_the_pairs_once(spark, tmp_path):
    rows = [(k, f"c{k % 3}", f"the good soup {k}", f"thank you for the soup {k}", [1.0, float(k)], [0.5, 1.0]) for k in range(30)]
    pairs = spark.createDataFrame(rows, "review_id long, store string, review string, reply string, va array<double>, vb array<double>")
    pairs.write.parquet(f"{tmp_path}/pairs")
    vectors = spark.createDataFrame([("soup", [1.0, 0.0]), ("good", [0.0, 1.0])], "word string, vec array<float>")
    lexicon = spark.createDataFrame([("joy", "good", 2.0)], "label string, token string, weight double")
    scored = score_pairs(spark.read.parquet(f"{tmp_path}/pairs"), vectors, ("va", "vb"), lexicon)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan parquet", plan)) == 1 and "Exchange" not in plan and "Join" not in plan
    assert scored.where("glove > 0.1").count() == 30 and {"glove", "tfidf", "sbert", "common_emotions"} < set(scored.columns)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_ids_of_rows_without_ids_of_their_own(spark, limit):
    rows = [(1, ["b", "z", "a", "b"], "x"), (1, ["b", "z", "a", "b"], "y"), (1, ["a"], "x"), (None, ["a", None], None), (None, [None, "a"], "n"),
            (None, ["a", None], None), (2, [], "e"), (2, None, "e"), (3, ["a", "b"], "m")]
    df = spark.createDataFrame(rows, "review_id long, t array<string>, other string").repartition(3)
    vocab = spark.createDataFrame([("a", 5), ("b", -6), (None, 7)], "word string, id int")
    got = token_sums.with_token_ids(df, vocab, {"i": F.col("t"), "j": F.reverse("t")}, 0, limit=limit)
    assert ("FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()) == (not limit)
    ids = {"a": 5, "b": -6}
    expected = [(k, t, o, [ids.get(x, 0) for x in t or []], [ids.get(x, 0) for x in (t or [])[::-1]]) for k, t, o in rows]
    assert got.columns == [*df.columns, "i", "j"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))


def test_blocks_move_a_vector_once_per_word(spark, monkeypatch):
    monkeypatch.setattr(token_sums, "BLOCK_CELLS", 40_000)
    rows = [(k % 20 if k % 7 else None, ["the", f"w{k % 11}"] * 20 if k % 5 else ["unknown"]) for k in range(60)]
    df = spark.createDataFrame(rows, "review_id long, a array<string>").repartition(3)
    vectors = spark.createDataFrame([(f"w{k}", [float(k), 1.0]) for k in range(11)] + [("the", [0.5, None]), ("short", [1.0])], "word string, vec array<double>")
    got = token_sums.with_token_sums(df, vectors, {"s": F.col("a")}, limit=0, tasks=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Summarizer" not in plan and "aggregate_metrics" not in plan and "FlatMapCoGroupsInArrow" in plan
    want = [(i, a, None if a == ["unknown"] else [20 * (0.5 + int(a[1][1:])), 20.0]) for i, a in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_no_worker_holds_a_vocabulary_that_grows(spark):
    vocab = spark.range(200_000).select(F.concat(F.lit("w"), "id").alias("word"), F.col("id").cast("int").alias("id"))
    df = spark.range(20).select(F.col("id").alias("review_id"), F.array(F.concat(F.lit("w"), F.col("id") * 9_999), F.lit("x")).alias("t"))
    got = token_sums.with_token_ids(df, vocab, {"i": F.col("t")}, -1)
    assert "EvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.review_id: r.i for r in got.collect()} == {k: [k * 9_999, -1] for k in range(20)}


def test_tokens_of_many_rows_are_looked_up_in_slices(spark, monkeypatch):
    held = []
    monkeypatch.setattr(token_sums, "SLICE", 3)
    for part in token_sums._slices(token_sums.pa.array([["a"]] * 8)):
        held.append(len(part))
    assert held == [3, 3, 2]


def test_rows_without_tokens_count_for_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_sums, "BLOCK_CELLS", 64 * 100)
    df = spark.range(2_000).select("id", F.array().cast("array<string>").alias("a"), F.when(F.col("id") % 500 == 0, F.array(F.lit("x"))).alias("b"))
    table = spark.createDataFrame([("x", 1)], "word string, id int")

    def rows_of_block(found):
        return lambda tokens: pa.array([[len(tokens)]] * len(tokens), pa.list_(pa.int32()))

    got = token_sums._by_blocks(df, table, {"i": F.col("a"), "j": F.col("b")}, 2, 1, "array<int>", rows_of_block).collect()
    assert len(got) == 2_000 and max(r.i[0] for r in got) <= 100
    ids = token_sums.with_token_ids(df, table, {"i": F.col("a"), "j": F.col("b")}, 0, limit=0, tasks=2)
    assert {(r.id, tuple(r.i), tuple(r.j)) for r in ids.collect()} == {(k, (), () if k % 500 else (1,)) for k in range(2_000)}
