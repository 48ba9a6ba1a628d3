"""Scores of two token lists or two vectors of the same row, without a shuffle.

Token counts of both sides are compared by sorting the two lists into one and folding
over it once, so a long text costs n log n and nothing leaves the row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_counts(a: Column, b: Column, add: Callable[[Column, Column], list[Column]],
                 finish: Callable[..., Column]) -> Column:
    """``finish`` of the sums of ``add(count in a, count in b)`` over the tokens of both lists.

    NULL if one of the lists is NULL. The result is taken inside the fold, so using it
    several times does not repeat the fold.
    """
    n = len(add(F.lit(0.0), F.lit(0.0)))

    def side(tokens: Column, flag: int) -> Column:
        return F.transform(tokens, lambda t: F.struct(t.alias("t"), F.lit(flag).alias("side")))

    def closed(acc: Column) -> list[Column]:
        return [acc[f"s{i}"] + x for i, x in enumerate(add(acc["in_a"], acc["in_b"]))]

    def state(token: Column, in_a: Column, in_b: Column, sums: list[Column]) -> Column:
        return F.struct(token.alias("t"), in_a.alias("in_a"), in_b.alias("in_b"),
                        *[x.alias(f"s{i}") for i, x in enumerate(sums)])

    def step(acc: Column, x: Column) -> Column:
        to_a = (1 - x["side"]).cast("double")
        to_b = x["side"].cast("double")
        same = state(acc["t"], acc["in_a"] + to_a, acc["in_b"] + to_b, [acc[f"s{i}"] for i in range(n)])
        return F.when(acc["t"] == x["t"], same).otherwise(state(x["t"], to_a, to_b, closed(acc)))

    zero = F.lit(0.0)
    start = state(F.lit(None).cast("string"), zero, zero, [zero] * n)
    merged = F.sort_array(F.concat(side(a, 0), side(b, 1)))
    return F.aggregate(merged, start, step, lambda acc: finish(*closed(acc)))


# Smoothed inverse document frequency in a collection of two texts, ln(3 / (1 + df)) + 1.
IDF_IN_BOTH = 1.0
IDF_IN_ONE = math.log(1.5) + 1.0


def tfidf_pair_cosine(a: Column, b: Column) -> Column:
    """Cosine of TF-IDF vectors fitted on the two token lists alone; 0 if it has no value."""
    def add(in_a: Column, in_b: Column) -> list[Column]:
        idf = F.when((in_a > 0) & (in_b > 0), F.lit(IDF_IN_BOTH)).otherwise(F.lit(IDF_IN_ONE))
        return [in_a * in_b, in_a * in_a * idf * idf, in_b * in_b * idf * idf]

    def cosine(dot: Column, aa: Column, bb: Column) -> Column:
        return F.try_divide(dot, F.sqrt(aa) * F.sqrt(bb))

    return F.coalesce(_fold_counts(a, b, add, cosine), F.lit(0.0))


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; 0 where a vector is missing, empty, zero or of another size."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, y: s + y)

    da, db = a.cast("array<double>"), b.cast("array<double>")
    dot = total(F.zip_with(da, db, lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(da, lambda x: x * x))) * F.sqrt(total(F.transform(db, lambda x: x * x)))
    return F.coalesce(F.try_divide(dot, norm), F.lit(0.0))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens, joined by a blank (tokens hold none)."""
    if n == 1:
        return tokens
    starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def ngram_counts(hypothesis: Column, reference: Column, n: int) -> Column:
    """struct<hyp, ref, overlap>: n-gram counts of two token lists, overlap clipped.

    The counts are ``size - (n - 1)`` also for shorter lists, where they are not positive.
    """
    if n < 1:
        raise ValueError("n has to be at least 1")
    overlap = _fold_counts(ngrams(hypothesis, n), ngrams(reference, n),
                           lambda x, y: [F.least(x, y)], lambda common: common)
    return F.struct((F.size(hypothesis) - (n - 1)).cast("double").alias("hyp"),
                    (F.size(reference) - (n - 1)).cast("double").alias("ref"),
                    overlap.alias("overlap"))


def f_score(precision: Column, recall: Column, alpha: float = 0.5) -> Column:
    """Weighted harmonic mean; 0 if either part is 0."""
    product = precision * recall
    blend = F.lit(1 - alpha) * precision + F.lit(alpha) * recall
    return F.when(product == 0, F.lit(0.0)).otherwise(product / blend)


def overlap_score(hyp: Column, ref: Column, overlap: Column, alpha: float = 0.5,
                  weight: float = 1.0) -> Column:
    """struct<p, r, f> from counts; ``weight`` takes the 1/weight power of p and r."""
    def ratio(count: Column) -> Column:
        part = F.when(count == 0, F.lit(0.0)).otherwise(overlap / count + 0.0)
        return part if weight == 1.0 else F.pow(part, F.lit(1.0 / weight))

    p, r = ratio(hyp), ratio(ref)
    return F.struct(p.alias("p"), r.alias("r"), f_score(p, r, alpha).alias("f"))
