"""Scores against brute force in plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from reviewlab.functions.labels import common_labels, label_jaccard, threshold_labels, union_labels
from reviewlab.functions.overlap import f_score, ngram_counts, tfidf_pair_cosine, vector_cosine
from reviewlab.operators import rouge

X, Y = F.col("x"), F.col("y")
SHAPE = "id long, x array<string>, y array<string>"


def token_lists(n, longest, words="abcdef", seed=5):
    r = random.Random(seed)
    make = lambda: [r.choice(words) for _ in range(r.randint(0, longest))]
    return [(i, make(), make()) for i in range(n)]


def brute_tfidf(a, b):
    ca, cb = Counter(a), Counter(b)
    idf = {t: math.log(3 / (1 + (t in ca) + (t in cb))) + 1 for t in {*ca, *cb}}
    dot = sum(ca[t] * cb[t] * idf[t] ** 2 for t in idf)
    norms = [math.sqrt(sum((c[t] * idf[t]) ** 2 for t in idf)) for c in (ca, cb)]
    return dot / math.prod(norms) if all(norms) else 0.0


def test_tfidf_equals_brute_force_and_is_symmetric(spark):
    rows = token_lists(60, 30)
    df = spark.createDataFrame(rows, SHAPE).select("id", tfidf_pair_cosine(X, Y).alias("s"), tfidf_pair_cosine(Y, X).alias("t"))
    for got in df.collect():
        _, a, b = rows[got.id]
        assert got.s == pytest.approx(brute_tfidf(a, b), abs=1e-12)
        assert got.t == pytest.approx(got.s, abs=1e-12)


def test_missing_texts_score_zero(value):
    none = F.lit(None).cast("array<string>")
    assert value(tfidf_pair_cosine(X, Y), x=none, y=F.array(F.lit("a"))) == 0
    assert value(vector_cosine(X, Y), x=F.array(F.lit(0.0)), y=F.array(F.lit(1.0))) == 0
    assert value(vector_cosine(X, Y), x=none.cast("array<double>"), y=F.array(F.lit(1.0))) == 0
    assert value(vector_cosine(X, Y), x=F.array(F.lit(1.0)), y=F.array(F.lit(1.0), F.lit(2.0))) == 0
    assert value(vector_cosine(X, Y), x=F.array(F.lit(3.0), F.lit(4.0)), y=F.array(F.lit(4.0), F.lit(3.0))) == pytest.approx(0.96)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngram_counts_equal_brute_force(spark, n):
    rows = token_lists(40, 12, "abc")
    df = spark.createDataFrame(rows, SHAPE).select("id", ngram_counts(X, Y, n).alias("c"))
    for got in df.collect():
        _, a, b = rows[got.id]
        grams = [Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1)) for t in (a, b)]
        assert tuple(got.c) == (len(a) - n + 1, len(b) - n + 1, (grams[0] & grams[1]).total())


def test_text_shorter_than_the_gram_has_no_score(spark):
    df = spark.createDataFrame([(1, ["a"], ["a", "b"])], "id long, hyp_tokens array<string>, ref_tokens array<string>")
    assert tuple(rouge.rouge_n(df, 3, "s").first().s) == (0.0, 0.0, 0.0)


def test_f_score(value):
    assert value(f_score(F.lit(0.5), F.lit(1.0))) == pytest.approx(2 / 3)
    assert value(f_score(F.lit(0.5), F.lit(1.0), 0.0)) == pytest.approx(1.0)
    assert value(f_score(F.lit(0.0), F.lit(1.0))) == 0


def brute_hits(ref, hyp, weight):
    """Aligned positions of ref, by recursion over prefixes."""
    @lru_cache(maxsize=None)
    def best(i, j):
        """(score, length of the run that ends here, step)."""
        if not i or not j:
            return 0.0, 0, None
        if ref[i - 1] == hyp[j - 1]:
            score, run, _ = best(i - 1, j - 1)
            return score + (run + 1) ** weight - run**weight, run + 1, (1, 1)
        a, b = best(i - 1, j)[0], best(i, j - 1)[0]
        return (a, 0, (1, 0)) if a >= b else (b, 0, (0, 1))

    at, hits = (len(ref), len(hyp)), set()
    while (step := best(*at)[2]) is not None:
        if step == (1, 1):
            hits.add(at[0] - 1)
        at = (at[0] - step[0], at[1] - step[1])
    return hits


def brute_counts(hyp_lines, ref_lines, weight):
    hyp, ref = [s.split() for s in hyp_lines], [s.split() for s in ref_lines]
    pool, overlap = Counter(t for line in hyp for t in line), 0.0
    for line in ref:
        hits = set().union(*(brute_hits(line, h, weight) for h in hyp))
        run = 0
        for k in sorted(hits):
            if not pool[line[k]]:
                continue
            pool[line[k]] -= 1
            run += 1
            if weight == 1 or k + 1 not in hits:
                overlap += run**weight
                run = 0
    return (sum(map(len, hyp)) ** weight, sum(len(x) ** weight for x in ref) ** weight, overlap)


def random_lines(n, seed):
    r = random.Random(seed)
    line = lambda: " ".join(r.choice("abcde") for _ in range(r.randint(0, 9)))
    return [(i, [line() for _ in range(r.randint(1, 4))], [line() for _ in range(r.randint(1, 4))]) for i in range(n)]


@pytest.mark.parametrize("weight", [1.0, 1.2, 2.0])
def test_union_of_alignments_equals_brute_force(spark, weight):
    rows = random_lines(120, seed=3)
    df = spark.createDataFrame(rows, "id long, x array<string>, y array<string>")
    for got in df.select("id", rouge.union_lcs_counts(X, Y, weight).alias("c")).collect():
        assert tuple(got.c) == pytest.approx(brute_counts(rows[got.id][1], rows[got.id][2], weight)), rows[got.id]


def test_many_line_pairs_do_not_fit_in_one_block(spark, monkeypatch):
    import pandas as pd

    rows = random_lines(30, seed=9)
    hyps, refs = pd.Series([r[1] for r in rows]), pd.Series([r[2] for r in rows])
    whole = rouge._batch_counts(hyps, refs, 1.5)
    monkeypatch.setattr(rouge, "CELLS", 300)
    assert rouge._batch_counts(hyps, refs, 1.5) == whole


@pytest.mark.parametrize("weight", [1.0, 1.3])
def test_blocks_of_moves_give_the_same_alignment(monkeypatch, weight):
    import pandas as pd

    rows = random_lines(40, seed=5)
    hyps, refs = pd.Series([r[1] for r in rows]), pd.Series([r[2] for r in rows])
    whole = rouge._batch_counts(hyps, refs, weight)
    monkeypatch.setattr(rouge, "_block", lambda m, n: 3)
    assert rouge._batch_counts(hyps, refs, weight) == whole


def test_lines_of_any_length_are_aligned_whole_in_bounded_memory():
    import tracemalloc

    import pandas as pd

    n = 6_000
    hyp = [f"w{k}" for k in range(n)]
    ref = [t if k % 3 else f"x{k}" for k, t in enumerate(hyp)]
    tracemalloc.start()
    (got,) = rouge._batch_counts(pd.Series([[" ".join(hyp)]]), pd.Series([[" ".join(ref)]]), 1.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == (n, n, n - n // 3)
    # A table of all moves would take 72 MB.
    assert peak < 30e6


def test_texts_are_whole_unless_a_limit_is_given(spark):
    df = spark.createDataFrame([("word " * 3000,)], "t string")
    sizes = df.select(F.size(rouge.whole_tokens(F.col("t"))), F.size(rouge.whole_tokens(F.col("t"), 1000)),
                      F.size(F.split(rouge.sentence_list(F.col("t"))[0], " "))).first()
    assert tuple(sizes) == (3000, 1000, 3000)


def test_missing_text_has_no_rouge(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "a"), (3, "", "a")], "id long, h string, r string")
    lines = df.select("id", rouge.sentence_list(F.col("h")).alias("hyp_lines"), rouge.sentence_list(F.col("r")).alias("ref_lines"))
    assert {r.id: r.s and r.s.f for r in rouge.rouge_lcs(lines, "s").collect()} == {1: None, 2: 1.0, 3: 0.0}
    tokens = df.select("id", rouge.whole_tokens(F.col("h")).alias("hyp_tokens"), rouge.whole_tokens(F.col("r")).alias("ref_tokens"))
    assert {r.id: r.s and r.s.f for r in rouge.rouge_n(tokens, 1, "s").collect()} == {1: None, 2: 1.0, 3: 0.0}


def test_overlap_is_clipped_by_the_hypothesis_only(spark):
    df = spark.createDataFrame([(1, ["a"], ["a", "a a"])], "id long, x array<string>, y array<string>")
    assert df.select(rouge.union_lcs_counts(X, Y).alias("c")).first().c.overlap == 1


def test_lcs_in_sql_functions_equals_the_batch_form(spark):
    rows = token_lists(40, 12, "abcd")
    df = spark.createDataFrame(rows, SHAPE)
    lines = [F.array(F.array_join(c, " ")) for c in (X, Y)]
    got = df.select(rouge.lcs_length(X, Y).alias("n"), rouge.union_lcs_counts(*lines).alias("c")).collect()
    assert all(r.n == r.c.overlap for r in got)


def test_a_text_equals_itself(spark):
    df = spark.createDataFrame([(1, "One two.\nThree four five")], "id long, t string")
    lines = df.select("id", rouge.sentence_list(F.col("t")).alias("hyp_lines"), rouge.sentence_list(F.col("t")).alias("ref_lines"))
    for weight in (1.0, 1.2):
        counts = rouge.rouge_lcs(lines, "s", weight=weight).first().s_counts
        assert counts.hyp > 0 and counts.overlap > 0
    assert tuple(rouge.rouge_lcs(lines, "s").first().s) == (1.0, 1.0, 1.0)


def test_references_are_pooled_or_the_best_is_taken(spark):
    rows = [(1, 0, ["a", "b"], ["a", "c"]), (1, 1, ["a", "b"], ["a", "b", "c"]), (1, 2, ["a", "b"], ["b", "a", "d"])]
    df = spark.createDataFrame(rows, "sample_id long, ref_id int, hyp_tokens array<string>, ref_tokens array<string>")
    scored = rouge.rouge_n(df, 1, "s")
    pooled = rouge.rouge_aggregate(scored, "s").first()
    assert (pooled.p, pooled.r) == (pytest.approx(5 / 6), pytest.approx(5 / 8))
    best = rouge.rouge_aggregate(scored, "s", "best").first()
    assert (best.p, best.r) == (1.0, pytest.approx(2 / 3))
    assert rouge.rouge_aggregate(scored, "s", "all").count() == 3


def test_label_sets(value):
    scores = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(s).alias("score"))
                       for n, s in (("b", 0.41), ("a", 0.9), ("c", 0.4), ("a", 0.5))])
    assert value(threshold_labels(X), x=scores) == ["a", "b"]
    ab, bc, no = F.array(F.lit("b"), F.lit("a")), F.array(F.lit("c"), F.lit("b")), F.array().cast("array<string>")
    assert value(common_labels(X, Y), x=ab, y=bc) == ["b"]
    assert value(union_labels(X, Y), x=ab, y=bc) == ["a", "b", "c"]
    assert value(label_jaccard(X, Y), x=ab, y=bc) == pytest.approx(1 / 3)
    assert value(label_jaccard(X, Y), x=no, y=bc) == 0
    assert value(label_jaccard(X, Y), x=no, y=no) is None


@pytest.mark.parametrize("weight", [1.0, 1.2, 0.7])
def test_only_tokens_that_matter_are_aligned(monkeypatch, weight):
    import numpy as np
    import pandas as pd

    shapes = []
    align = rouge._align

    def seen(refs, hyps, sizes, weight):
        shapes.append((len(refs), *hyps.shape))
        return align(refs, hyps, sizes, weight)

    monkeypatch.setattr(rouge, "_align", seen)
    rnd = random.Random(8)
    mixed = [[[" ".join(rnd.choice("abcdefghxyz") for _ in range(rnd.randint(0, 12))) for _ in range(3)] for _ in range(60)] for _ in range(2)]
    thin = rouge._batch_counts(*map(pd.Series, mixed), weight)
    with monkeypatch.context() as m:
        m.setattr(rouge, "_thinned", lambda line, other: np.arange(len(line)))
        assert rouge._batch_counts(*map(pd.Series, mixed), weight) == thin
    shapes.clear()
    hyp, ref = pd.Series([["p q r s t", "a u v w b"]]), pd.Series([["c d e f g", "a h i j k b l m"]])
    ((_, _, overlap),) = rouge._batch_counts(hyp, ref, weight)
    # Of the four pairs of lines one has common tokens; "a * b" against "a * b *".
    assert shapes == [(4, 3, 1)] and overlap == 2.0
