"""Periodic runs of words, found in a grammar of the texts.

A task takes blocks of whole texts. The words of a block become numbers, and Re-Pair writes them as a
grammar: pairs that occur twice or more are replaced, the most frequent first, until none is left. Pairs
that do not touch a more frequent one are replaced in the same round, in every text of the block; what is left
of a text is paired up evenly. Each nonterminal X -> YZ stands for the words of its first occurrence.

A run, a stretch of period q and ``max(LEAST, 2 q)`` words or more, crosses the boundary of exactly one
nonterminal that holds it whole. So it is enough to look, once per nonterminal, for runs across its
boundary. Each such run has two equal ``GRAM``-grams q words apart: for q > NEAR one of the two next to the
boundary is among them, for smaller q one that starts at most NEAR + GRAM words before it. These are the only
candidates; how far their period reaches is found by bisection over prefix hashes, within X. What was found is
moved to every place where the derivation has X, intervals within another of their period are merged into it, and
the runs that remain are compared word by word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import slices, text_bytes

LEAST = 12
GRAM = LEAST // 2
NEAR = 10
#: Bytes of text whose grammar is built together; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20


# -------------------------------------------------------------------- grammar

class Grammar:
    """Rules X -> YZ over a block of texts; rule k is symbol ``n_words + k``."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        """Word numbers of all texts, and where each text begins, with the end of the last."""
        self.n_words = int(words.max(initial=-1)) + 1
        self.left, self.right, self.at, self.size = ([] for _ in range(4))
        self.count = 0
        symbols, at = words.astype(np.int64), np.arange(len(words))
        last = np.zeros(len(words), bool)
        last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
        fresh = np.ones(len(words), bool)  # whether a pair that begins here may occur twice
        length = np.ones(len(words), np.int64)
        while len(symbols) > 1:
            open_ = np.flatnonzero(fresh[:-1] & ~last[:-1])
            if not len(open_):
                break
            code = symbols[open_] << 32 | symbols[open_ + 1]
            pairs, which, times = np.unique(code, return_inverse=True, return_counts=True)
            fresh[open_] = times[which] > 1
            if times.max() < 2:
                break
            # A place per pair, the most frequent first; no two pairs share one.
            rank = np.empty(len(pairs), np.int64)
            rank[np.lexsort((pairs, times))] = np.arange(1, len(pairs) + 1)
            key = np.zeros(len(symbols) + 1, np.int64)
            key[open_] = np.where(times[which] > 1, rank[which], 0)
            key[-1] = 0
            before = np.concatenate([[0], key[:-2]])
            best = (key[:-1] > 0) & (key[:-1] >= before) & (key[:-1] >= key[1:])
            # Equal neighbours are one symbol repeated: every second place of the stretch.
            starts = best & ~np.concatenate([[False], best[:-1]])
            place = np.arange(len(symbols))
            best &= (place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0
            chosen = np.flatnonzero(best)
            number = np.searchsorted(open_, chosen)
            _, first, rule = np.unique(which[number], return_index=True, return_inverse=True)
            made = self._add(symbols[chosen[first]], symbols[chosen[first] + 1], at[chosen[first]],
                             length[chosen[first]], length[chosen[first] + 1])
            symbols[chosen] = made + rule
            length[chosen] += length[chosen + 1]
            last[chosen] = last[chosen + 1]
            fresh[chosen] = True
            fresh[chosen[chosen > 0] - 1] = True
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            # The place before a pair may be the second half of another pair, which goes.
            back = chosen[chosen > 1]
            fresh[back[~keep[back - 1]] - 2] = True
            symbols, at, last, fresh, length = (x[keep] for x in (symbols, at, last, fresh, length))
        self._pair_up(symbols, at, last, length)
        self.left, self.right, self.at, self.size = (np.concatenate([np.empty(0, np.int64), *x]) for x in (self.left, self.right, self.at, self.size))

    def _add(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, size: np.ndarray, more: np.ndarray) -> int:
        """Rules of such halves, first seen at such places; the first one's symbol."""
        for held, new in ((self.left, left), (self.right, right), (self.at, at), (self.size, size + more)):
            held.append(new)
        first = self.n_words + self.count
        self.count += len(left)
        return first

    def _pair_up(self, symbols: np.ndarray, at: np.ndarray, last: np.ndarray, length: np.ndarray) -> None:
        """Rules that pair neighbours until each text is one symbol: its root."""
        while True:
            begins = np.concatenate([[True], last[:-1]])[:len(symbols)]
            place = np.arange(len(symbols))
            offset = place - np.maximum.accumulate(np.where(begins, place, 0))
            chosen = np.flatnonzero((offset % 2 == 0) & ~last)
            if not len(chosen):
                break
            made = self._add(symbols[chosen], symbols[chosen + 1], at[chosen], length[chosen], length[chosen + 1])
            symbols[chosen] = made + np.arange(len(chosen))
            length[chosen] += length[chosen + 1]
            last[chosen] = last[chosen + 1]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, at, last, length = (x[keep] for x in (symbols, at, last, length))
        self.roots, self.root_at = symbols, at

    def middle(self) -> np.ndarray:
        """Where the second half of each rule begins, in its first occurrence."""
        word = self.left < self.n_words
        return self.at + np.where(word, 1, self.size[np.where(word, 0, self.left - self.n_words)])

    def places(self, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every (rule, place in the block) at which the derivation has one of these rules."""
        wanted = np.zeros(self.n_words + self.count, bool)
        wanted[rules + self.n_words] = True
        leads = wanted.copy()
        # Halves are older than the rule they stand in: levels of rules, from the words up.
        for a, b in self._levels():
            leads[self.n_words + a:self.n_words + b] |= leads[self.left[a:b]] | leads[self.right[a:b]]
        symbol, at = self.roots[leads[self.roots]], self.root_at[leads[self.roots]]
        halves = self.middle() - self.at
        found, where = [], []
        while len(symbol):
            found.append(symbol[wanted[symbol]] - self.n_words)
            where.append(at[wanted[symbol]])
            inner = symbol >= self.n_words
            rule, at = symbol[inner] - self.n_words, at[inner]
            symbol, at = np.concatenate([self.left[rule], self.right[rule]]), np.concatenate([at, at + halves[rule]])
            symbol, at = symbol[leads[symbol]], at[leads[symbol]]
        return (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found, where))

    def _levels(self) -> Iterator[tuple[int, int]]:
        """Stretches of rules whose halves are all before the stretch."""
        newest = np.maximum(self.left, self.right) - self.n_words
        a = 0
        while a < self.count:
            # The first rule from a on that has a half within the stretch ends it.
            step = 1024
            b = a
            while b < self.count:
                late = np.flatnonzero(newest[b:b + step] >= a)
                if len(late):
                    b += int(late[0])
                    break
                b = min(b + step, self.count)
            yield a, b
            a = b


# ----------------------------------------------------------------------- runs

class Reach:
    """How many words after two places are equal, by bisection over prefix hashes."""

    def __init__(self, words: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        with np.errstate(over="ignore"):
            values = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            values = (values ^ (values >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) ^ (values >> np.uint64(7))
            self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(words), base, np.uint64)]))
            self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.power[:-1])])

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n words from a and from b, a < b, have one hash."""
        with np.errstate(over="ignore"):
            return (self.sum[a + n] - self.sum[a]) * self.power[b - a] == self.sum[b + n] - self.sum[b]

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        return self._bisect(a, b, most, 1)

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words before a and b that are equal."""
        return self._bisect(a, b, most, -1)

    def _bisect(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        n = np.zeros(len(a), np.int64)
        step = 1 << int(max(most.max(initial=0), 1)).bit_length()
        while step:
            tried = n + step
            fits = np.flatnonzero(tried <= most)
            t = tried[fits]
            ok = self.same(a[fits], b[fits], t) if way > 0 else self.same(a[fits] - t, b[fits] - t, t)
            n[fits[ok]] = t[ok]
            step >>= 1
        return n


class ExactReach(Reach):
    """The same, word by word: for texts in which two different stretches have one hash."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = self.words
        return np.fromiter((np.array_equal(w[i:i + k], w[j:j + k]) for i, j, k in zip(a.tolist(), b.tolist(), n.tolist(), strict=True)), bool, len(a))


def gram_numbers(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A number for each place, the same where the next GRAM words are; those that a text's end cuts have their own."""
    n = len(words)
    code, k = words.astype(np.int64), 1
    for more in (2, 3):
        # 1 -> 2 -> 6 words, exactly: a pair or triple of numbers gets a number.
        size = int(code.max(initial=0)) + 1
        cut = [np.concatenate([code[j * k:], np.zeros(min(j * k, n), np.int64)]) for j in range(more)]
        if size ** more < 2**62:
            joint = cut[0]
            for c in cut[1:]:
                joint = joint * size + c
            code = np.unique(joint, return_inverse=True)[1]
        else:
            joint = np.unique(cut[0] * size + cut[1], return_inverse=True)[1]
            code = np.unique(joint * size + cut[2], return_inverse=True)[1] if more == 3 else joint
        k *= more
    ends = np.repeat(bounds[1:], np.diff(bounds))
    cut_off = np.flatnonzero(np.arange(n) + GRAM > ends)
    code[cut_off] = n + np.arange(len(cut_off))
    return code


def candidates(grammar: Grammar, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rule, a, q): places a and a + q within the rule's first occurrence that hold the same gram near its boundary."""
    grams = gram_numbers(words, bounds)
    low, middle, high = grammar.at, grammar.middle(), grammar.at + grammar.size
    large = np.flatnonzero(grammar.size >= LEAST)
    rules, starts, periods = [], [], []

    # Small periods: any gram that comes again at most NEAR words on, from NEAR + GRAM words before the boundary.
    again = {}
    close = np.zeros(len(words), bool)
    for q in range(1, min(NEAR, len(words) - 1) + 1):
        hit = np.flatnonzero(grams[:-q] == grams[q:])
        if len(hit):
            again[q] = hit
            close[hit] = True
    if again:
        seen = np.concatenate([[0], np.cumsum(close)])
        some = large[seen[middle[large]] > seen[np.maximum(middle[large] - NEAR - GRAM + 1, low[large])]]
        for q, hit in again.items():
            first = np.searchsorted(hit, np.maximum(middle[some] - q - GRAM + 1, low[some]))
            # A boundary may have up to three stretches of one period around it.
            for _ in range(3):
                ok = first < len(hit)
                rule, a = some[ok], hit[first[ok]]
                near = (a < middle[rule]) & (a + q + GRAM <= high[rule])
                rules.append(rule[near])
                starts.append(a[near])
                periods.append(np.full(near.sum(), q))
                # On to the next stretch: the first hit after one that has no successor.
                gaps = np.flatnonzero(np.diff(hit) > 1)
                following = np.searchsorted(gaps, first)
                first = np.where(following < len(gaps), gaps[np.minimum(following, len(gaps) - 1)] + 1 if len(gaps) else len(hit), len(hit))

    # Larger ones: other places, within the rule, of the grams right after and right before the boundary.
    order = np.argsort(grams, kind="stable")
    sorted_grams = grams[order]
    after = np.full(len(words), len(words))
    before = np.full(len(words), -1)
    equal = sorted_grams[1:] == sorted_grams[:-1]
    after[order[:-1][equal]] = order[1:][equal]
    before[order[1:][equal]] = order[:-1][equal]
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    joint = sorted_grams * (len(words) + 1) + order
    for shift in (0, -GRAM):
        place = middle[large] + shift
        fits = (place >= low[large]) & (place + GRAM <= high[large])
        rule, place = large[fits], place[fits]
        some = (after[place] + GRAM <= high[rule]) | (before[place] >= low[rule])
        rule, place = rule[some], place[some]
        begin = np.searchsorted(joint, grams[place] * (len(words) + 1) + low[rule])
        end = np.searchsorted(joint, grams[place] * (len(words) + 1) + high[rule] - GRAM, "right")
        times = end - begin
        which = np.repeat(np.arange(len(rule)), times)
        other = order[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + begin[which]]
        a, q = np.minimum(other, place[which]), np.abs(other - place[which])
        ok = (q > NEAR) & (2 * q <= grammar.size[rule[which]])
        rules.append(rule[which][ok])
        starts.append(a[ok])
        periods.append(q[ok])
    return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in (rules, starts, periods))


def find_runs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of all texts, ordered by start and period; starts count within the block."""
    none = (np.empty(0, np.int64),) * 3
    if len(words) < LEAST:
        return none
    grammar = Grammar(words, bounds)
    found = candidates(grammar, words, bounds)
    for reach in (Reach, ExactReach):
        crossing = across_boundaries(grammar, reach(words), *found)
        if not len(crossing[0]):
            return none
        start, length, q = merge(len(words), *translate(grammar, *crossing))
        if all(np.array_equal(words[s:s + n - p], words[s + p:s + n]) for s, n, p in zip(start.tolist(), length.tolist(), q.tolist(), strict=True)):
            break
    return start, length, q


def across_boundaries(grammar: Grammar, reach: Reach, rule: np.ndarray, a: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs (rule, begin, end, q) across the boundary of each rule, within it, from its candidates; sorted by rule."""
    low, middle, high = grammar.at[rule], grammar.middle()[rule], grammar.at[rule] + grammar.size[rule]
    begin = a - reach.backward(a, a + q, a - low)
    end = a + q + reach.forward(a, a + q, high - a - q)
    ok = (begin < middle) & (middle < end) & (end - begin >= np.maximum(LEAST, 2 * q))
    rule, begin, end, q = rule[ok], (begin - low)[ok], (end - low)[ok], q[ok]
    # Of equal stretches the smallest period counts.
    order = np.lexsort((q, end, begin, rule))
    rule, begin, end, q = (x[order] for x in (rule, begin, end, q))
    fresh = np.ones(len(rule), bool)
    fresh[1:] = (rule[1:] != rule[:-1]) | (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    return rule[fresh], begin[fresh], end[fresh], q[fresh]


def translate(grammar: Grammar, rule: np.ndarray, begin: np.ndarray, end: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of rules, which are sorted by rule, at every place of the derivation."""
    found, at = grammar.places(np.unique(rule))
    first, last = np.searchsorted(rule, found), np.searchsorted(rule, found, "right")
    times = last - first
    which = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    at = np.repeat(at, times)
    return at + begin[which], at + end[which], q[which]


def merge(n_words: int, begin: np.ndarray, end: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the intervals that lie within no other of their period, each with its smallest period."""
    order = np.lexsort((-end, begin, q))
    begin, end, q = begin[order], end[order], q[order]
    # Ends shifted by period, so that the running maximum starts anew with each one.
    high = end + np.searchsorted(np.unique(q), q) * (n_words + 1)
    inside = np.concatenate([[False], np.maximum.accumulate(high)[:-1] >= high[1:]])
    begin, end, q = begin[~inside], end[~inside], q[~inside]
    order = np.lexsort((q, end, begin))
    begin, end, q = begin[order], end[order], q[order]
    least = np.ones(len(q), bool)
    least[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    begin, end, q = begin[least], end[least], q[least]
    order = np.lexsort((q, begin))
    return begin[order], (end - begin)[order], q[order]


# ------------------------------------------------------------------- operator

def repeat_tail(n: int, doc_id: int) -> np.ndarray | None:
    """Places of the words after the tail of one text in ten is replaced by copies of its first words; None: unchanged."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + np.arange(n - a) % p
    return places


def text_runs(batch: pa.RecordBatch, plant: bool) -> pa.RecordBatch:
    ids, texts, numbers = batch.column(0).to_pylist(), [], []
    known: dict[bytes, int] = defaultdict(count().__next__)
    for key, text in zip(ids, batch.column(1).to_pylist(), strict=True):
        words = (text or b"").split()  # by space and the bytes 9 to 13
        number = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        places = repeat_tail(len(words), key) if plant and key is not None else None
        if places is not None:
            number = number[places]
            words = [words[i] for i in places.tolist()]
        texts.append(words)
        numbers.append(number)
    bounds = np.cumsum([0, *map(len, texts)])
    start, length, period = find_runs(np.concatenate([np.empty(0, np.int64), *numbers]), bounds)
    owner = np.searchsorted(bounds, start, "right") - 1
    first = np.searchsorted(owner, np.arange(len(ids) + 1))
    out = []
    for k, (key, words) in enumerate(zip(ids, texts, strict=True)):
        own = slice(first[k], first[k + 1])
        s, n, q = (start[own] - bounds[k]).tolist(), length[own].tolist(), period[own].tolist()
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s, n, q, strict=True))
        if s:
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, start[own] - bounds[k] + period[own], 1)
            np.add.at(step, start[own] - bounds[k] + length[own], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
        best = min(range(len(s)), key=lambda i: (-n[i], s[i], q[i]), default=None)
        top = (None,) * 4 if best is None else (s[best], n[best], q[best], 1000 * n[best] // q[best])
        out.append((key, len(s), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest(),
                    [{"start": a, "length": b, "period": c} for a, b, c in zip(s, n, q, strict=True)], b" ".join(words).decode()))
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 10, ARROW.types, strict=True)], schema=ARROW)


RUN = pa.list_(pa.struct({"start": pa.int64(), "length": pa.int64(), "period": pa.int64()}))
ARROW = pa.schema({"doc_id": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(),
                   "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string(), "runs": RUN, "collapsed": pa.string()})
SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
          "collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def periodic_runs(df: DataFrame, plant: bool = False, keep_texts: bool = True, id_col: str = "doc_id", text: str = "text",
                  block: int = BLOCK_BYTES) -> DataFrame:
    """Runs of every text, the longest one, and the text without their repetitions.

    ``plant`` replaces the tail of one text in ten by copies, as the query's contract says, before runs are sought.
    ``keep_texts`` keeps ``runs`` and ``collapsed`` beside their digests. A missing or empty text has no runs. Rows and ids
    that are repeated stay; a missing id plants nothing; other columns are not read. Nothing is shuffled.
    """
    out = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", block):
            made = text_runs(batch, plant)
            yield made if keep_texts else made.select(out)

    schema = SCHEMA if keep_texts else SCHEMA.split(", runs array")[0]
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_bytes(text).alias("_text"))
    return source.mapInArrow(work, schema).withColumnRenamed("doc_id", id_col)
