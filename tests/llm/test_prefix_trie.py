"""The prefix trie against SQL, a plain trie, and parentheses matched by a stack."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from checks.compare import differences, open_tables
from reviewlab.llm import prefix_trie as pt
from reviewlab.llm.queries import QUERIES, SQL
from tests.conftest import SMALL


def plain_trie(paths: dict[int, tuple]) -> Counter:
    """Nodes of a trie over {conv_id: turns}, each turn (role, text)."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ends = defaultdict(list)
    for c, path in paths.items():
        ends[path].append(c)
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def rebuilt(rows: list[tuple], family: int = 5, heads: int = 9) -> dict[int, tuple]:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    plain = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0], hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest()))]
             for c, v in own.items()}
    out = {}
    for c, turns in plain.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        out[c] = tuple(plain.get(base, [])[:h] + turns[h:])
    return out


def as_rows(df) -> Counter:
    return Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                   for r in df.collect())


@pytest.mark.parametrize("seed", range(40))
def test_findclose(seed, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", 4)
    rnd = random.Random(seed)
    opens, depth = [True], 1
    for _ in range(rnd.randint(0, 300)):
        up = rnd.random() < rnd.choice([0.4, 0.5, 0.7]) or depth == 1
        opens.append(up)
        depth += 1 if up else -1
    opens += [False] * depth
    stack, close = [], {}
    for i, up in enumerate(opens):
        if up:
            stack.append(i)
        else:
            close[stack.pop()] = i
    at = np.flatnonzero(opens)
    assert pt.Parentheses(np.array(opens)).findclose(at).tolist() == [close[i] for i in at.tolist()]


def test_range_minimum():
    rnd = random.Random(3)
    values = np.array([rnd.randint(-9, 9) for _ in range(37)])
    pairs = [(a, b) for a in range(37) for b in range(a, 37)]
    got = pt.RangeMinimum(values)(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [values[a:b + 1].min() for a, b in pairs]


def random_rows(seed: int, n: int) -> list[tuple]:
    """Many shared beginnings, a group of equal conversations, and some that hold nothing."""
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-50, 1000), n):
        length = 3 if rnd.random() < 0.3 else rnd.randint(1, 14)
        for k in range(length):
            same = length == 3 or rnd.random() < 0.7
            rows.append((c, k, "user" if k % 2 == 0 else "assistant", "same text é" if same else rnd.choice(["", "a", "bb", "ccc"])))
    return rows


@pytest.mark.parametrize(("seed", "turns"), [(1, 1), (2, 5), (3, 40), (4, 1 << 18)])
def test_trie_of_random_conversations(spark, monkeypatch, seed, turns):
    # Workers take the sizes from the functions they are sent, so small shards are set there too.
    monkeypatch.setattr(pt, "SHARD_TURNS", turns)
    monkeypatch.setattr(pt, "PIECE_BYTES", 20)
    data = random_rows(seed, 300)
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    assert as_rows(pt.prefix_trie(pt.rebuild(df, 5, 9))) == plain_trie(rebuilt(data))


def test_rows_of_any_kind(spark):
    data = [(5, None, None, None), (5, 1, "user", "x"), (5, 1, "user", "x"), (5, 1, "assistant", "y"), (6, 0, "user", ""), (None, 0, "user", "gone"),
            (7, 0, "user", "long " * 50000), (-3, 2, "a", "1"), (-3, None, "a", "0"), (2**40, 9, "", "z"), (8, 0, "user", "x")]
    df = spark.createDataFrame([(*r, 1, "n") for r in data], "conv_id long, turn long, role string, text string, depth int, key string")
    assert as_rows(pt.prefix_trie(pt.rebuild(df, 5, 9))) == plain_trie(rebuilt(data))
    assert pt.prefix_trie(pt.rebuild(df.limit(0), 5, 9)).count() == 0


def test_a_conversation_of_many_turns(spark):
    data = [(c, k, "user", f"{k % 7}") for c in (10, 11) for k in range(120)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    assert as_rows(pt.prefix_trie(pt.rebuild(df, 5, 9))) == plain_trie(rebuilt(data))


def test_query_against_sql(spark):
    name = "op12_prefix_trie"
    assert differences(spark, open_tables(SMALL), SMALL, QUERIES[name], SQL[name]) == ""
