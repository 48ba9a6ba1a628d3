"""Periodic runs against a brute-force search of every start and period."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from reviewlab.llm import runs as pr
from reviewlab.llm.queries import QUERIES
from tests.conftest import SMALL


def brute(words: list) -> list[tuple[int, int, int]]:
    """Maximal stretches of each period, the smallest period of each stretch."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def planted(words: list, doc_id: int | None) -> list:
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def want(text: str | None, doc_id: int | None) -> tuple:
    words = planted(re.findall("[^\x20\x09-\x0d]+", text or ""), doc_id)
    found = brute(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def texts_of(rnd: random.Random) -> list[int]:
    """Words of random letters, with stretches repeated, and repeated again."""
    letters = rnd.choice([1, 2, 3, 30])
    words = [rnd.randrange(letters) for _ in range(rnd.randint(0, 60))]
    for _ in range(rnd.randint(0, 4)):
        part = words[rnd.randint(0, len(words)):][:rnd.randint(1, 25)]
        at = rnd.randint(0, len(words))
        words[at:at] = part * rnd.randint(1, 5)
        if rnd.random() < 0.3 and words:
            words[rnd.randrange(len(words))] = rnd.randrange(letters)
    return words[:400]


@pytest.mark.parametrize("seed", range(150))
def test_runs_of_random_texts(seed):
    rnd = random.Random(seed)
    texts = [texts_of(rnd) for _ in range(rnd.randint(1, 6))]
    texts += [t for t in texts if rnd.random() < 0.3]
    bounds = np.cumsum([0, *map(len, texts)])
    start, length, period = pr.find_runs(np.array([w for t in texts for w in t], np.int64), bounds)
    assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == [
        (s + b, n, q) for t, b in zip(texts, bounds.tolist(), strict=False) for s, n, q in brute(t)]


@pytest.mark.parametrize("make", [lambda: [0] * 500, lambda: [0, 1] * 300, lambda: list(range(40)) * 12, lambda: list(range(500)),
                                  lambda: [bin(i).count("1") % 2 for i in range(1024)], lambda: ([0, 1, 0] * 20 + [2]) * 7])
def test_regular_texts(make):
    words = make()
    got = pr.find_runs(np.array(words, np.int64), np.array([0, len(words)]))
    assert list(zip(*(x.tolist() for x in got), strict=True)) == brute(words)


def test_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    got = pr.find_runs(np.array(b, np.int64), np.array([0, len(b)]))
    assert list(zip(*(x.tolist() for x in got), strict=True)) == brute(b)


def test_grammar_gives_the_words_back():
    rnd = random.Random(1)
    texts = [texts_of(rnd) for _ in range(20)]
    words, bounds = np.array([w for t in texts for w in t], np.int64), np.cumsum([0, *map(len, texts)])
    g = pr.Grammar(words, bounds)

    def spell(s: int) -> list[int]:
        return [s] if s < g.n_words else spell(g.left[s - g.n_words]) + spell(g.right[s - g.n_words])

    assert [spell(s) for s in g.roots.tolist()] == [t for t in texts if t]
    for k in range(g.count):
        assert words[g.at[k]:g.at[k] + g.size[k]].tolist() == spell(g.n_words + k)


def test_rows_of_any_kind(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 20), (4, "x " * 30000), (4, "x " * 30000), (6, "one\x0btwo\x0cthree four\x85 " * 5),
            (7, "w1 w2 w3 w4 w5 w6 " * 2), (8, "lone"), *[(k, " ".join(f"w{i * k % 17}" for i in range(90))) for k in range(100, 160)]]
    df = spark.createDataFrame([(*r, 5, "s") for r in rows], "doc_id long, text string, n_runs int, _text string")
    long = (4, 1, 0, 30000, 1, 30000000, hashlib.sha256(b"0,30000,1\n").hexdigest(), hashlib.sha256(b"x").hexdigest())
    plain = sorted([want(t, d) for d, t in rows if d != 4] + [long] * 2, key=str)
    for block in (1, 1 << 20):
        assert sorted(map(tuple, pr.periodic_runs(df, plant=True, keep_texts=False, block=block).collect()), key=str) == plain
    assert pr.periodic_runs(df.limit(0)).count() == 0


def test_collapsed_texts(spark):
    df = spark.createDataFrame([(None, "start " + "a b c " * 6 + "end")], "doc_id long, text string")
    row = pr.periodic_runs(df).first()
    assert row.collapsed == "start a b c end" and [tuple(r) for r in row.runs] == [(1, 18, 3)]


def test_query_against_brute_force(spark):
    docs = [r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if len(r.text) < 6000]
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_grammar_runs"](spark, SMALL).collect()}
    assert len(docs) > 150 and all(got[r.doc_id] == want(r.text, r.doc_id) for r in docs)


def test_stretches_with_one_hash():
    # Sums of powers of an odd base, taken in 64 bits, cannot tell these two halves apart.
    words = np.array([bin(i).count("1") % 2 for i in range(4096)] + [1 - bin(i).count("1") % 2 for i in range(4096)], np.int64)
    reach = pr.Reach(words)
    assert reach.same(np.array([0]), np.array([4096]), np.array([4096]))[0] and not np.array_equal(words[:4096], words[4096:])
    start, length, period = pr.find_runs(words, np.array([0, len(words)]))
    assert all(np.array_equal(words[s:s + n - q], words[s + q:s + n]) for s, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
