"""Training examples on literal ids."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from reviewlab import values as v
from reviewlab.functions import tokens as ids
from reviewlab.operators import examples
from reviewlab.operators.candidates import nucleus_filter, sample_candidate
from reviewlab.operators.models import encode_texts, generate_replies, score_labels_batch, tag_entities

X, Y = F.col("x"), F.col("y")


def arr(*items):
    return F.array(*[F.lit(i) for i in items]).cast("array<int>")


def test_pad_or_cut(value):
    assert value(ids.pad_or_cut(X, 4, 0), x=arr(7, 8)) == [7, 8, 0, 0]
    assert value(ids.pad_or_cut(X, 1, 0), x=arr(7, 8)) == [7]
    assert value(ids.pad_or_cut(X, 2, -100), x=arr()) == [-100, -100]


def test_seq2seq(value):
    got = value(ids.seq2seq_example(X, Y, 4, eos=1, pad=3), x=arr(7, 8), y=arr(5, 6))
    assert got == {"input_ids": [7, 8, 3, 3], "decoder_input_ids": [1, 5, 6, 3], "labels": [5, 6, 1, -100]}
    assert value(ids.seq2seq_example(X, Y, 4, 1, 3, "test")["labels"], x=arr(7), y=arr(5)) == [5, 1, 3, 3]


def test_causal_pads(value):
    got = value(ids.causal_example(X, Y, 8, mark=9, eos=1, pad=3), x=arr(0, 7), y=arr(5, 6))
    assert got == {"input_ids": [0, 7, 9, 5, 6, 1, 3, 3], "attention_mask": [0, 0, 1, 1, 1, 1, 0, 0],
                   "labels": [9, 5, 6, 1, 3, 3, 3, 3], "too_long": False}
    aligned = value(ids.causal_example(X, Y, 8, 9, 1, 3, "aligned")["labels"], x=arr(0, 7), y=arr(5, 6))
    assert aligned == [-100, -100, 5, 6, 1, -100, -100, -100]


def test_causal_cuts_the_review_and_flags_long_replies(value):
    got = value(ids.causal_example(X, Y, 5, 9, 1, 3), x=arr(0, 7, 8), y=arr(5, 6))
    assert got["input_ids"] == [0, 9, 5, 6, 1] and got["attention_mask"] == [0, 1, 1, 1, 1] and not got["too_long"]
    long = value(ids.causal_example(X, Y, 3, 9, 1, 3), x=arr(0, 7, 8), y=arr(5, 6))
    assert long["input_ids"] == [9, 5, 6, 1] and long["too_long"]


def test_prefixes(value):
    got = value(ids.rated_prefix(0, arr(1), arr(2), arr(3), X, [[11], [12, 13], [14], [15]]), x=arr(7))
    assert got == [0, 11, 1, 12, 13, 2, 14, 3, 15, 7]
    assert value(ids.prompt_prefix(0, 2, 3, X), x=arr(7)) == [0, 2, 2, 2, 7]


def test_pair_is_cut_as_by_a_tokenizer(spark):
    from tokenizers import Tokenizer, models

    words = {str(i): i for i in range(100)}
    tok = Tokenizer(models.WordLevel(words, unk_token="0"))
    from tokenizers import pre_tokenizers

    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    r = random.Random(2)
    rows = [(i, [r.randint(1, 99) for _ in range(r.randint(0, 14))], [r.randint(1, 99) for _ in range(r.randint(0, 14))])
            for i in range(80)]
    df = spark.createDataFrame(rows, "id long, x array<int>, y array<int>")
    for n in (7, 10):
        tok.enable_truncation(n)
        for row in df.select("id", ids.pair_example(X, Y, [98, 99], n).alias("e")).collect():
            _, a, b = rows[row.id]
            want = tok.encode(" ".join(map(str, a)), " ".join(map(str, [98, 99, *b]))).ids
            assert row.e.input_ids == want and row.e.labels == want


def test_lm_example(value):
    assert value(ids.lm_example(X, 5, 1, 2, 0), x=arr(7, 8)) == {"input_ids": [1, 7, 8, 2, 0], "attention_mask": [1, 1, 1, 1, 0]}
    assert value(ids.lm_example(X, 3, 1, 2, 0), x=arr(7, 8, 9)) == {"input_ids": [1, 7, 8], "attention_mask": [1, 1, 1]}


def test_masks_and_restored_labels(value):
    assert value(ids.attention_mask(X, 3), x=arr(3, 5)) == [0, 1]
    assert value(ids.restore_ignored(X, 3), x=arr(5, -100)) == [5, 3]


def test_vocabulary(spark):
    words = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "word string")
    vocab = examples.build_vocab(words, first_id=5)
    assert {r.word: r.id for r in vocab.collect()} == {"a": 5, "b": 6}
    more = examples.extend_vocab(vocab, ["x", "a", "y"])
    assert {r.word: r.id for r in more.collect()} == {"a": 5, "b": 6, "x": 7, "y": 8}
    assert {r.word: r.id for r in examples.extend_vocab(vocab).collect()}[v.CONTACT] == 11
    df = spark.createDataFrame([(1, ["b", "z", "a", "b"]), (2, []), (3, None)], "review_id long, t array<string>")
    for limit in (1 << 20, 0):
        got = examples.encode_tokens(df, more, {"i": "t"}, 0, limit=limit).collect()
        assert {r.review_id: r.i for r in got} == {1: [6, 0, 5, 6], 2: [], 3: []}


def brute_nucleus(scores, top_k, top_p):
    import math

    ranked = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    if top_k:
        kth = ranked[min(top_k, len(ranked)) - 1][1]
        ranked = [x for x in ranked if x[1] >= kth]
    weights = [math.exp(s) for _, s in ranked]
    kept, before = [], 0.0
    for (token, _), w in zip(ranked, weights, strict=True):
        if not top_p or before <= top_p:
            kept.append((token, w))
        before += w / sum(weights)
    return {t: w / sum(w for _, w in kept) for t, w in kept}


@pytest.mark.parametrize(("top_k", "top_p"), [(0, 0.5), (2, 0.0), (3, 0.6), (0, 0.0), (0, 0.01)])
def test_candidates_equal_brute_force(spark, top_k, top_p):
    r = random.Random(8)
    groups = {"big": {f"t{i:03}": r.gauss(0, 2) for i in range(200)}, "tie": {"a": 1.0, "b": 1.0, "c": 1.0, "d": 0.0},
              "sure": {"a": 9.0, "b": 0.0}, "one": {"a": 0.3}}
    rows = [(g, t, s) for g, ts in groups.items() for t, s in ts.items()]
    df = spark.createDataFrame(rows, "grp string, token string, score double").repartition(3)
    got = {}
    for limit in (1 << 20, 0):
        for row in nucleus_filter(df, top_k=top_k, top_p=top_p, limit=limit).collect():
            got.setdefault(row.grp, {})[row.token] = row.prob
        for g, ts in groups.items():
            assert got.pop(g) == pytest.approx(brute_nucleus(ts, top_k, top_p))


@pytest.mark.parametrize("top_k", [3, 60])
def test_top_k_beyond_the_limit_of_a_task(spark, monkeypatch, top_k):
    from reviewlab.operators import candidates

    monkeypatch.setattr(candidates, "PER_TASK", 2)
    r = random.Random(9)
    groups = {"big": {f"t{i:03}": float(r.randrange(40)) / 8 for i in range(150)}, "tie": {c: 1.0 for c in "abcdef"}, "one": {"a": 0.3}}
    df = spark.createDataFrame([(g, t, s) for g, ts in groups.items() for t, s in ts.items()], "grp string, token string, score double")
    got = {}
    for row in nucleus_filter(df, top_k=top_k, top_p=0.8).collect():
        got.setdefault(row.grp, {})[row.token] = row.prob
    assert all(got[g] == pytest.approx(brute_nucleus(ts, top_k, 0.8)) for g, ts in groups.items())


def test_draws_follow_the_probabilities(spark):
    df = spark.range(4000).select(F.col("id").alias("grp"), F.explode(F.array(*[
        F.struct(F.lit(t).alias("token"), F.lit(p).alias("prob")) for t, p in (("a", 0.7), ("b", 0.3), ("c", 0.0))])).alias("c"))
    kept = df.select("grp", "c.*")
    drawn = {r.token: r["count"] for r in sample_candidate(kept, 1).groupBy("token").count().collect()}
    assert set(drawn) == {"a", "b"} and sum(drawn.values()) == 4000
    assert 0.66 < drawn["a"] / 4000 < 0.74
    again = sample_candidate(kept.repartition(2), 1)
    assert sample_candidate(kept, 1).exceptAll(again).count() == 0


# Models are defined inside the tests: workers do not have to import this module.

def test_one_failing_text_does_not_spoil_others(spark):
    def picky():
        def model(texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return [t.upper() for t in texts]

        return model

    df = spark.createDataFrame([(1, "a\nb"), (2, "bad"), (3, None), (4, " c ")], "id long, p string")
    got = {r.id: r.predicted_reply for r in generate_replies(df, "p", picky).collect()}
    assert got == {1: "AB", 2: v.FAILED_REPLY, 3: v.FAILED_REPLY, 4: "C"}


def test_taggers_and_scorers_return_structs(spark):
    def tagger():
        return lambda texts: [[{"word": w, "type": "LOCATION"} for w in t.split()] for t in texts]

    def scorer():
        return lambda texts: [[("x", 0.5)] for _ in texts]

    df = spark.createDataFrame([(1, "a b"), (2, None)], "id long, t string")
    got = {r.id: r.entities for r in tag_entities(df, "t", tagger).collect()}
    assert [e.word for e in got[1]] == ["a", "b"] and got[2] is None
    assert score_labels_batch(df, "t", scorer, "s").where("id = 1").first().s[0].score == 0.5


def test_equal_texts_are_encoded_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def encoder():
        def encode(texts):
            seen.add(len(texts))
            return [[float(len(t))] for t in texts]

        return encode

    df = spark.createDataFrame([(i, "same", f"t{i % 3}") for i in range(30)] + [(99, None, "t0")], "review_id long, a string, b string")
    for limit in (1 << 20, 0):
        seen.value = 0
        got = encode_texts(df, {"x": "a", "y": "b"}, encoder, limit=limit).collect()
        assert seen.value == 4 and len(got) == 31
        assert all(r.y == [2.0] for r in got) and all(r.x == ([4.0] if r.a else None) for r in got)


def test_results_are_handed_on_per_batch_of_the_model():
    import pandas as pd

    from reviewlab.operators.models import outcome_function

    run = outcome_function(lambda: lambda texts: [t.upper() for t in texts], "string", batch=4).func
    parts = list(run(iter([pd.Series(["a", None] * 5), pd.Series([None, None])])))
    assert [len(p) for p in parts] == [4, 4, 2, 2]
    assert [x for p in parts for x in p["result"]] == ["A", None] * 5 + [None, None]
