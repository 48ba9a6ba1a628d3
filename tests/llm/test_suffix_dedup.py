"""Suffix-array dedup against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from reviewlab.llm import suffix_dedup as sd
from reviewlab.llm.queries import QUERIES
from tests.conftest import SMALL


def brute(texts, length=sd.LENGTH):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) of every text."""
    counts = Counter(hash(t[p:p + length]) for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for p in range(len(t) - length + 1):
            if counts[hash(t[p:p + length])] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        removed = np.cumsum(gone[:-1]) > 0 if len(t) else np.zeros(0, bool)
        spans = int(np.sum(removed & ~np.concatenate([[False], removed[:-1]])))
        kept = bytes(np.frombuffer(t, np.uint8)[~removed])
        out.append((len(t), int(removed.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def words(rnd, n):
    return " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def odd_texts():
    rnd = random.Random(3)
    shared = [words(rnd, 60) for _ in range(3)]
    texts = [None, "", "short", "a" * 199, "b" * 200, "b" * 200, "c" * 205, "d" * 700, "zy" * 300, "z" * 150 + "y" * 150 + "x" * 150]
    for k in range(12):
        texts.append(words(rnd, 50) + " " + shared[k % 3] + " " + words(rnd, 30) + shared[0][k:k + 230] + "é" * k)
    texts += [words(rnd, 4000) + shared[1], "é" * 150 + words(rnd, 20), "é" * 150 + words(rnd, 20), texts[12], texts[12],
              ("line of the same words again and again\n" * 12) + words(rnd, 9), "z" * 150 + "y" * 150 + "x" * 150 + "w"]
    return texts


@pytest.mark.parametrize("seed", range(4))
def test_order_is_that_of_sorted_suffixes(seed):
    rnd = random.Random(seed)
    depth = 8
    runs, buffer = [], b""
    for _ in range(60):
        body = bytes(rnd.choice(b"ab" if seed % 2 else b"abcdefgh") for _ in range(rnd.randint(1, 40))) + b"\x01\xff"
        runs.append((len(buffer), len(buffer) + len(body) - 2))
        buffer += body + bytes(depth + 8)
    first, last = (np.array(x) for x in zip(*runs, strict=True))
    got = sd.suffix_order(buffer, first, last, depth)
    places = sorted((buffer[p:p + depth], p) for a, b in runs for p in range(a, b + 1))
    assert [buffer[p:p + depth] for p in got.tolist()] == [x for x, _ in places]
    assert sorted(got.tolist()) == sorted(p for _, p in places)
    lcp = sd.common_prefix(buffer, got[:-1], got[1:], depth)
    for a, b, n in zip(got[:-1].tolist(), got[1:].tolist(), lcp.tolist(), strict=True):
        assert buffer[a:a + n] == buffer[b:b + n] and (n == depth or buffer[a + n] != buffer[b + n])


def test_runs_cover_every_window_once():
    data = np.frombuffer(words(random.Random(1), 900).encode(), np.uint8)
    _, first, last = sd.anchor_runs(data)
    assert np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)]).tolist() == list(range(len(data) - 199))


@pytest.mark.parametrize("hot", [sd.HOT, 3, 1])
def test_rows_of_any_kind(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    texts = odd_texts()
    rows = [(None if k == 14 else k, t, 7) for k, t in enumerate(texts)] + [(12, texts[12], 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    got = sd.remove_repeats(df).collect()
    want = brute([(r[1] or "").encode() for r in rows])
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(
        (r[0], *w) for r, w in zip(rows, want, strict=True))
    for r in got:
        if r.kept_text.isascii():
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = brute([d.text.encode() for d in docs])
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op1_suffix_array_dedup"](spark, SMALL).collect()}
    assert got == {d.doc_id: w for d, w in zip(docs, want, strict=True)}
    assert sum(w[1] for w in want) > 0
