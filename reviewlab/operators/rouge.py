"""ROUGE-N, ROUGE-L and ROUGE-W over tables of (sample, reference) pairs.

Each row holds one hypothesis and one reference; several rows of the same sample are
its references. Scores are structs <p, r, f>.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlab.functions.overlap import ngram_counts, overlap_score
from reviewlab.functions.text import normalise_text, truncate_sentences, truncate_text, words

COUNTS = "struct<hyp double, ref double, overlap double>"


def _tokens(normal: Column, by: str) -> Column:
    """Words, or single characters, of a normalised text."""
    if by == "words":
        return words(normal)
    if by == "characters":
        return F.filter(F.split(normal, ""), lambda c: (c != "") & (c != " "))
    raise ValueError(f"unknown token kind {by!r}")


def whole_tokens(text: Column, limit: int | None = None, unit: str = "words", by: str = "words") -> Column:
    """Normalised tokens of a text, the whole of it or, with a ``limit``, what truncation leaves.

    ``by`` is ``words`` or ``characters``. For another tokenizer, give ``rouge_n`` the
    columns made by ``models.encode_texts``.
    """
    cut = F.replace(text, F.lit("\n"), F.lit(" ")) if limit is None else truncate_text(text, limit, unit)
    return _tokens(normalise_text(cut), by)


def sentence_list(text: Column, limit: int | None = None, unit: str = "words", by: str = "words") -> Column:
    """Normalised lines of a text, all or, with a ``limit``, what truncation leaves; tokens between blanks."""
    lines = F.split(text, "\n") if limit is None else truncate_sentences(text, limit, unit)
    return F.transform(lines, lambda line: F.array_join(_tokens(normalise_text(line), by), " "))


def rouge_n(df: DataFrame, n: int, out: str, hyp: str = "hyp_tokens", ref: str = "ref_tokens",
            alpha: float = 0.5) -> DataFrame:
    """Add ``<out>_counts`` and the score ``out`` of n-gram overlap of two token columns."""
    counted = df.withColumn(f"{out}_counts", ngram_counts(F.col(hyp), F.col(ref), n))
    return counted.withColumn(out, score_of(F.col(f"{out}_counts"), alpha))


def score_of(counts: Column, alpha: float = 0.5, weight: float = 1.0) -> Column:
    return overlap_score(counts["hyp"], counts["ref"], counts["overlap"], alpha, weight)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two token lists, in SQL functions.

    One table row is kept as an array, which is copied per token of ``a``: meant for
    one-line texts.
    """
    def row(prev: Column, token: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(b)),
            F.array(F.lit(0)),
            lambda cur, j: F.concat(cur, F.array(
                F.when(F.get(b, j - 1) == token, F.get(prev, j - 1) + 1)
                .otherwise(F.greatest(F.get(prev, j), F.get(cur, j - 1))))),
        )

    start = F.array_repeat(F.lit(0), F.size(b) + 1)
    table = F.aggregate(a, start, row, lambda last: F.element_at(last, -1))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(table)


# Pairs whose lines are aligned together, and cells of the move tables held at once.
PAIRS = 256
CELLS = 8_000_000
# Least number of anti-diagonals whose moves are held at once.
LEAST_BLOCK = 256


def _block(m: int, n: int) -> int:
    """Anti-diagonals per block: a state is 32 bytes a cell and a move one, so both take the same room."""
    return max(LEAST_BLOCK, math.isqrt(32 * (m + n)))


def _fill(refs: np.ndarray, hyps: np.ndarray, weight: float, state: tuple[np.ndarray, ...], first: int, last: int,
          move: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The state after anti-diagonals ``first`` to ``last - 1`` of all pairs; their moves go to ``move``."""
    m, n = len(refs), len(hyps)
    older, old, older_run, old_run = state
    # What a match gains after a run of matches of each length.
    runs = np.arange(min(m, n) + 2, dtype=np.float64) ** weight
    gains = runs[1:] - runs[:-1]
    for d in range(first, last):
        lo, hi = max(1, d - n), min(m, d - 1)
        match = refs[lo - 1:hi] == hyps[d - hi - 1:d - lo][::-1]
        up, left = old[lo - 1:hi], old[lo:hi + 1]
        new, new_run = np.zeros_like(old), old_run
        if weight == 1.0:
            gain = 1.0
        else:
            run = older_run[lo - 1:hi]
            gain = gains[run]
            new_run = np.zeros_like(old_run)
            new_run[lo:hi + 1] = np.where(match, run + 1, 0)
        new[lo:hi + 1] = np.where(match, older[lo - 1:hi] + gain, np.maximum(up, left))
        if move is not None:
            move[d - first, lo:hi + 1] = np.where(match, 0, np.where(up >= left, 1, 2))
        older, old, older_run, old_run = old, new, old_run, new_run
    return older, old, older_run, old_run


def _align(refs: np.ndarray, hyps: np.ndarray, sizes: np.ndarray, weight: float) -> np.ndarray:
    """Aligned reference tokens of many line pairs: (ref token, pair) -> bool.

    ``refs`` and ``hyps`` are (token, pair) ids, padded with ids that match nothing. The
    tables of all pairs are filled together, one anti-diagonal after the other. Moves: 0 match, 1 drop
    the reference token (also on a tie), 2 drop the hypothesis token. Only the state before each
    block of anti-diagonals is kept; the moves of a block are made again when the way back
    comes to it, so memory grows with m * sqrt(m + n).
    """
    (m, pairs), n = refs.shape, len(hyps)
    step, end = _block(m, n), m + n + 1
    blocks = [(first, min(first + step, end)) for first in range(2, end, step)]
    states = [tuple(np.zeros((m + 1, pairs), kind) for kind in (np.float64, np.float64, np.int32, np.int32))]
    for first, last in blocks[:-1]:
        states.append(_fill(refs, hyps, weight, states[-1], first, last))

    hits = np.zeros((m, pairs), dtype=bool)
    i, j = sizes[0].copy(), sizes[1].copy()
    while blocks:
        first, last = blocks.pop()
        move = np.zeros((last - first, m + 1, pairs), dtype=np.int8)
        _fill(refs, hyps, weight, states.pop(), first, last, move)
        at = np.flatnonzero((i > 0) & (j > 0) & (i + j >= first))
        while len(at):
            kind = move[i[at] + j[at] - first, i[at], at]
            matched = at[kind == 0]
            hits[i[matched] - 1, matched] = True
            i[at] -= kind != 2
            j[at] -= kind != 1
            at = at[(i[at] > 0) & (j[at] > 0) & (i[at] + j[at] >= first)]
    return hits


def _thinned(line: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Places of the tokens of ``line`` that its alignment with ``other`` depends on.

    Those that ``other`` has, and the first of each run of tokens that it has not: without a match, the table
    repeats the row or column before, and the way back passes straight through.
    """
    shared = np.zeros(max(line.max(), other.max()) + 1, dtype=bool)
    shared[other] = True
    kept = shared[line]
    kept[1:] |= shared[line[:-1]]
    kept[0] = True
    return np.flatnonzero(kept)


def _padded(lines: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((max(map(len, lines)), len(lines)), fill, dtype=np.int64)
    for k, line in enumerate(lines):
        out[:len(line), k] = line
    return out


def _mark(lines: list[tuple[np.ndarray, np.ndarray, np.ndarray]], weight: float) -> None:
    """Set the hits of (ref line, hyp line, hits of the ref line), similar sizes together; lines without a common token have none."""
    thin: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    # Lines come in many pairs.
    sets = {id(line): set(line.tolist()) for r, h, _ in lines for line in (r, h)}
    for k, (r, h, _) in enumerate(lines):
        if not sets[id(r)].isdisjoint(sets[id(h)]):
            at = _thinned(r, h)
            thin[k] = r[at], h[_thinned(h, r)], at
    order = sorted(thin, key=lambda k: (len(thin[k][0]), len(thin[k][1])))
    while order:
        chunk, m, n = [], 0, 0
        while order:
            r, h, _ = thin[order[-1]]
            wide, high = max(m, len(r)), max(n, len(h))
            if chunk and min(wide + high, _block(wide, high)) * wide * (len(chunk) + 1) > CELLS:
                break
            chunk.append(order.pop())
            m, n = wide, high
        picked = [thin[k] for k in chunk]
        sizes = np.array([[len(r) for r, _, _ in picked], [len(h) for _, h, _ in picked]])
        found = _align(_padded([r for r, _, _ in picked], -1), _padded([h for _, h, _ in picked], -2), sizes, weight)
        for k, (r, _, at) in enumerate(picked):
            lines[chunk[k]][2][at[found[:len(r), k]]] = True


def _batch_counts(hyps: pd.Series, refs: pd.Series, weight: float) -> list[tuple[float, float, float]]:
    """Counts of many pairs: every reference line against all hypothesis lines.

    Aligned reference tokens consume the tokens of the hypothesis, each of which counts
    once. The tokens of the reference are not consumed. Weighted hits are collected over
    neighbouring aligned tokens, and a run that ends on a token already used up stays
    open until the next run of the line ends.
    """
    pairs, lines = [], []
    for hyp, ref in zip(hyps, refs, strict=True):
        ids: dict[str, int] = {}
        hyp_lines, ref_lines = (
            [np.array([ids.setdefault(t, len(ids)) for t in s.split()], dtype=np.int64) for s in side]
            for side in ([] if hyp is None else hyp, [] if ref is None else ref))
        hits = [np.zeros(len(line), dtype=bool) for line in ref_lines]
        lines += [(r, h, hit) for r, hit in zip(ref_lines, hits, strict=True) for h in hyp_lines]
        pairs.append((len(ids), hyp_lines, ref_lines, hits))
    _mark(lines, weight)

    counts = []
    for n_ids, hyp_lines, ref_lines, hits in pairs:
        n_hyp = float(sum(map(len, hyp_lines))) ** weight
        n_ref = float(sum(len(line) ** weight for line in ref_lines)) ** weight
        left = np.bincount(np.concatenate([*hyp_lines, np.array([], dtype=np.int64)]), minlength=n_ids)
        counts.append((n_hyp, n_ref, _overlap(ref_lines, hits, left, weight)))
    return counts


def _overlap(ref_lines: list[np.ndarray], hits: list[np.ndarray], available: np.ndarray, weight: float) -> float:
    """Weighted hits of all lines, of which each token counts as often as it is ``available``."""
    if not any(hit.any() for hit in hits):
        return 0.0
    tokens = np.concatenate([line[hit] for line, hit in zip(ref_lines, hits, strict=True)])
    order = np.argsort(tokens, kind="stable")
    rank = np.empty(len(tokens), dtype=np.int64)
    rank[order] = np.arange(len(tokens)) - np.searchsorted(tokens[order], tokens[order])
    used = rank < available[tokens]
    if weight == 1.0:
        return float(used.sum())
    last = np.concatenate([~np.append(hit[1:], False)[hit] for hit in hits])
    line = np.repeat(np.arange(len(hits)), [hit.sum() for hit in hits])
    # A run reaches from behind the last end in its line to the next one; what no end follows does not count.
    ends, line = last[used], line[used]
    before = np.cumsum(ends) - ends
    _, run, sizes = np.unique(line * (len(ends) + 1) + before, return_inverse=True, return_counts=True)
    closed = np.bincount(run, weights=ends) > 0
    return float((sizes[closed] ** weight).sum())


def union_lcs_counts(hyp: Column, ref: Column, weight: float = 1.0) -> Column:
    """struct<hyp, ref, overlap> of two lists of normalised lines, in Arrow batches."""
    if weight <= 0:
        raise ValueError("weight has to be greater than 0")

    @F.pandas_udf(COUNTS)
    def counts(hyps: pd.Series, refs: pd.Series) -> pd.DataFrame:
        rows = []
        for at in range(0, len(hyps), PAIRS):
            rows += _batch_counts(hyps.iloc[at:at + PAIRS], refs.iloc[at:at + PAIRS], weight)
        return pd.DataFrame(rows, columns=["hyp", "ref", "overlap"], dtype="float64")

    # Not deterministic by declaration: a filter on the score must not run the UDF again.
    return counts.asNondeterministic()(hyp, ref)


def rouge_lcs(df: DataFrame, out: str, hyp: str = "hyp_lines", ref: str = "ref_lines",
              weight: float = 1.0, alpha: float = 0.5) -> DataFrame:
    """Add ``<out>_counts`` and the score ``out``: ROUGE-L, or ROUGE-W for another weight.

    A missing text has no score and is left out of means.
    """
    known = F.col(hyp).isNotNull() & F.col(ref).isNotNull()
    counts = F.when(known, union_lcs_counts(F.col(hyp), F.col(ref), weight))
    counted = df.withColumn(f"{out}_counts", counts)
    return counted.withColumn(out, score_of(F.col(f"{out}_counts"), alpha, weight))


def rouge_aggregate(df: DataFrame, score: str, mode: str = "avg", sample: str = "sample_id",
                    reference: str = "ref_id", alpha: float = 0.5, weight: float = 1.0) -> DataFrame:
    """Scores of samples with several references.

    ``avg`` pools the counts of all references, ``best`` takes the reference with the
    highest recall (the first on a tie); both give one row per sample. ``all`` keeps a row
    per reference.
    """
    counts = f"{score}_counts"
    if mode == "avg":
        pooled = F.struct(*[F.sum(F.col(counts)[c]).alias(c) for c in ("hyp", "ref", "overlap")])
        return df.groupBy(sample).agg(pooled.alias(counts)).withColumn(
            score, score_of(F.col(counts), alpha, weight)).select(sample, f"{score}.*")
    if mode == "best":
        rank = F.struct(F.col(score)["r"], -F.col(reference))
        return df.groupBy(sample).agg(F.max_by(F.col(score), rank).alias(score)).select(sample, f"{score}.*")
    if mode == "all":
        return df.select(sample, reference, f"{score}.*")
    raise ValueError(f"unknown mode {mode!r}")


def rouge_mean(scores: DataFrame) -> DataFrame:
    """Mean p, r and f over samples."""
    return scores.agg(*[F.avg(c).alias(c) for c in ("p", "r", "f")])
