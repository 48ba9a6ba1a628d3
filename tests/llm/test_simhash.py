"""SimHash near-dedup against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from reviewlab.llm.queries import QUERIES
from reviewlab.llm.simhash import GrayIndex, components, fingerprint, forest, gray_rank, near_duplicates
from tests.conftest import SMALL


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", "  \n", "One", "One two", "ONE two three", "Ä É words stay É as they are", "a b c d " * 9,
                                  "a b c d e\x1cf g"])
def test_fingerprint_is_the_majority_of_shingle_bits(text):
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_gray_rank_sorts_so_that_neighbours_differ_in_one_bit():
    codes = np.arange(256, dtype=np.uint64)
    order = codes[np.argsort(gray_rank(codes))]
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()


@pytest.mark.parametrize("n", [0, 1, 2, 17, 900])
def test_index_finds_exactly_the_close_pairs(n):
    rnd = random.Random(n)
    fps = []
    for _ in range(n):
        base = rnd.choice(fps) if fps and rnd.random() < 0.7 else rnd.getrandbits(64)
        fps.append(base ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randrange(4))}))
    fps = np.array(sorted(set(fps)), np.uint64)
    fps = fps[np.argsort(gray_rank(fps))]
    got = {(int(x), int(y)) for a, b in GrayIndex(fps).pairs(2) for x, y in zip(a, b, strict=True)} if n else set()
    assert got == {(i, j) for j in range(len(fps)) for i in range(j) if int(fps[i] ^ fps[j]).bit_count() <= 2}
    a, b = forest(fps) if n else ([], [])
    assert len(a) < max(1, len(fps))


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_rows_of_any_kind(spark):
    base = "word" + " word".join(map(str, range(400)))
    rows = [(1, None, 1), (2, "", 1), (3, " \t\n", 1), (4, base, 1), (5, base + " end", 1), (5, base + " end", 1), (None, base, 1),
            (6, "x " * 20000, 1), (7, "UPPER lower", 1), (8, "upper LOWER", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(near_duplicates(df).collect(), key=str)
    ids = [r[0] if r[0] is not None else 10**9 for r in rows]
    want = plain_components([plain_fingerprint(r[1]) for r in rows], ids)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == sorted(
        (str(r[0]), f"{plain_fingerprint(r[1]):016x}", c) for r, c in zip(rows, want, strict=True))
    assert near_duplicates(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    fps = [plain_fingerprint(d.text) for d in docs]
    want = plain_components(fps, [d.doc_id for d in docs])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash_gray_index"](spark, SMALL).collect()}
    assert got == {d.doc_id: (f"{f:016x}", c) for d, f, c in zip(docs, fps, want, strict=True)}
