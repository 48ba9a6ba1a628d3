"""Quality rules: counts over words and lines, and perplexity bands of an n-gram model.

The model is one of characters within words, for each language its own: a word stands between
four begin signs and an end sign, and each of its characters is predicted from the ``ORDER - 1``
before it. Spark counts the n-grams of all words of all texts; tasks add up what they saw
before it is shuffled. Interpolated modified Kneser-Ney estimates, with discounts from the
counts of counts of each order and language, follow from joins and aggregates over the counted
n-grams. What a text needs of the model is the log probability of its n-grams, all of which
were counted, so the model is a table from hash to log probability.

* A table of up to ``MODEL_BYTES`` is sent to the tasks as two arrays sorted by hash, and looked
  up by binary search once per different word of a batch.
* Beyond that, the n-grams of a text, with their counts, meet the table in a join.

Every text is part of what the model was counted from, so an n-gram that occurs nowhere else would look
likely just for that, the more so the more copies its text has. For the verdict, n-grams are counted over
the different texts of a language, and one that only a single text has, however often and in however many
copies, has the probability that the model would give it without all its occurrences; all others keep theirs.

No n-gram of characters crosses a word, so a second model of the same kind is one of words: ``WORD_ORDER``
of them, over the different texts of each language, with two begin signs and an end sign a text. Its
n-grams grow with the input, so it is never sent whole: those of the texts are shuffled, packed and a share of
them at a time, to where those with the same middle word are counted and scored (``word_scores``).

A text is rejected if this perplexity lies outside its language's band, median +- ``WIDTH`` robust
standard deviations of its logarithm, over all different texts of the language that pass the base rules,
or if that of its words lies above the upper end of its band. Below is what shares passages with others.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlab.llm.common import slices, text_bytes
from reviewlab.scale import lookup_join
from reviewlab.session import shared_folder

ORDER = 5
WORD_ORDER = 3
BEGIN, STOP = "\x02", "\x03"
MODEL_BYTES = 64 << 20
WIDTH = 6.0
#: Least half-width of a band, in log perplexity.
LEAST_WIDTH = 0.2
#: Words that a task counts before it hands their n-grams on, and n-grams that it hands on at once.
WORDS = 150_000
GRAMS = 1 << 16
#: Bytes of text whose n-grams of words are one part, turns in which the parts are worked off, and how often a word occurs that is frequent.
PART_BYTES = 8 << 20
TURNS = 4
FREQUENT = 4_000_000
LEAST_WORDS = 50
MOST_REPEATED = 50

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder by columns: of n-grams in order that is a small part of the rows of a checkpoint."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ngrams-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    # What the rows were shuffled through is of no use once they are written.
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


# ------------------------------------------------------------- n-grams of words

def word_points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words with their signs, the first place of each n-gram, and its word's number."""
    joined = "".join(f"{BEGIN * (ORDER - 1)}{w}{STOP}" for w in words)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    begins = np.cumsum(sizes + ORDER - 1) - sizes - ORDER + 1
    first = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begins, sizes)
    return points, first, np.repeat(np.arange(len(words)), sizes)


def gram_hash(points: np.ndarray, first: np.ndarray, order: int = ORDER) -> np.ndarray:
    """A 64-bit hash of the ``order`` code points, or hashes of words, from each place on."""
    h = np.full(len(first), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(order):
        h = (h ^ points[first + k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def decoded_words(text: bytes) -> list[str]:
    return text.decode("utf-8", "replace").translate(_SPACES).split(" ")


def coded_words(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The different words of binary texts, each text's words as places among them, and how many words each has."""
    try:
        strings = texts.cast(pa.string())
    except pa.ArrowInvalid:
        strings = pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
    lists = pc.ascii_split_whitespace(strings)
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    # White space at an end leaves an empty word.
    some = (pc.binary_length(words).to_numpy() > 0)[codes]
    owner = np.repeat(np.arange(len(sizes)), sizes)[some]
    return words, codes[some].astype(np.int64), np.bincount(owner, minlength=len(sizes))


#: The six ASCII white space characters; others stay within words.
_SPACES = {c: " " for c in (9, 10, 11, 12, 13)}


class _Words:
    """Words of the different texts of a language: how often, how often with copies, and the least and largest key of their texts.

    A word has a row for each batch that has it.
    """

    def __init__(self) -> None:
        self.words: list[str] = []
        self.sums: list[np.ndarray] = []

    def add(self, texts: pa.Array, copies: np.ndarray, keys: np.ndarray) -> None:
        words, codes, sizes = coded_words(texts)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.zeros((4, len(words)), np.int64)
        sums[0] = np.bincount(codes, minlength=len(words))
        sums[2], sums[3] = 2**63 - 1, -2**63
        np.add.at(sums[1], codes, copies[owner])
        np.minimum.at(sums[2], codes, keys[owner])
        np.maximum.at(sums[3], codes, keys[owner])
        some = sums[0] > 0
        self.words += words.filter(pa.array(some)).to_pylist()
        self.sums.append(sums[:, some])

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        if not self.words:
            return
        points, first, owner = word_points(self.words)
        once, every, lowest, highest = np.concatenate(self.sums, axis=1)
        _, at, back = np.unique(gram_hash(points, first), return_index=True, return_inverse=True)
        low, high = np.full(len(at), 2**63 - 1), np.full(len(at), -2**63)
        np.minimum.at(low, back, lowest[owner])
        np.maximum.at(high, back, highest[owner])
        # Sums of whole numbers: a float would lose the last digits of counts beyond 2^53.
        n, m = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        np.add.at(n, back, every[owner])
        np.add.at(m, back, once[owner])
        at = first[at]
        del first, owner, back
        for i in range(0, len(at), GRAMS):
            grams = points[at[i:i + GRAMS, None] + np.arange(ORDER)[None, :]]
            texts = grams.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(grams), pa.string()), pa.array([texts[j:j + ORDER] for j in range(0, len(texts), ORDER)], pa.string()),
                *(pa.array(x[i:i + GRAMS]) for x in (n, m, low, high))], names=["lang", "gram", "n", "m", "low", "high"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, _Words] = {}
    for batch in slices(batches, "_text"):
        for lang, own in by_language(batch):
            words = held.setdefault(lang, _Words())
            words.add(own.column("_text"), *(own.column(c).to_numpy() for c in ("copies", "_key")))
            if len(words.words) > WORDS:
                yield from held.pop(lang).rows(lang)
    for lang, words in held.items():
        yield from words.rows(lang)


def by_language(batch: pa.RecordBatch, lang: str = "lang") -> Iterator[tuple[str, pa.RecordBatch]]:
    """The rows of each language."""
    langs = batch.column(lang).dictionary_encode()
    for i, name in enumerate(langs.dictionary.to_pylist()):
        yield name, batch.filter(pc.equal(langs.indices, i))


def different_texts(df: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, _key, _text, copies): each text of a language once; _key is a digest of both.

    Only texts with copies are shuffled, after those of one task were combined.
    """
    rows = df.select(language(lang).alias("lang"), text_bytes(text).alias("_text")).withColumn("_key", text_key())
    classes = cut_lineage(rows.groupBy("_key").agg(F.count("*").alias("copies")).where("copies > 1"))
    marked = lookup_join(rows.withColumn("_row", F.monotonically_increasing_id()), classes, ["_key"], ["_row"], "left")
    several = marked.where("copies > 1").groupBy("_key", "copies").agg(F.any_value("lang").alias("lang"), F.any_value("_text").alias("_text"))
    return marked.where("copies IS NULL").select("lang", "_key", "_text", F.lit(1).cast("long").alias("copies")).unionByName(several)


def text_key(lang: str = "lang") -> Column:
    return F.xxhash64(lang, "_text")


def gram_counts(texts: DataFrame) -> DataFrame:
    """(lang, gram, n, m, only) over all words; a missing language is a language of its own.

    ``n`` counts copies of a text, ``m`` does not; ``only`` is the key of the text that has the n-gram, missing
    if several have it.
    """
    parts = texts.mapInArrow(_count_grams, "lang string, gram string, n long, m long, low long, high long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), only_text(F.col("low"), F.col("high")))


def only_text(low: Column, high: Column) -> Column:
    """The key of the text if the least and the largest key of a group are the same."""
    return F.when(F.min(low) == F.max(high), F.min(low)).alias("only")


def language(lang: str = "lang") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{lang}`").cast("string")), F.lit("-"))


# ----------------------------------------------------------------- n-grams over words

def word_hashes(lang: str, words: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of the words of a text of ``lang`` between its begin and end signs; ``known`` is filled."""
    from xxhash import xxh3_64_intdigest

    seed = xxh3_64_intdigest(lang.encode())
    for w in set(words).difference(known):
        known[w] = xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"), seed)
    # No word is empty or a space.
    begin, stop = xxh3_64_intdigest(b"", seed), xxh3_64_intdigest(b" ", seed)
    return np.array([begin] * (WORD_ORDER - 1) + [known[w] for w in words] + [stop], np.uint64)


def _word_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray]]:
    """(language, key, hashes of words) of each text that has words."""
    known: dict[str, dict[str, int]] = {}
    for batch in slices(batches, "_text"):
        for lang, key, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "_key", "_text")), strict=True):
            words = [w for w in decoded_words(text) if w]
            if words:
                own = known.setdefault(lang, {})
                yield lang, key, word_hashes(lang, words, own)
                if len(own) > WORDS:
                    own.clear()


#: The columns of the words of an n-gram.
_PLACES = [f"w{i}" for i in range(1, WORD_ORDER + 1)]


def _word_rows(lang: str, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    points = np.concatenate([x for _, x in held])
    sizes = np.array([len(x) for _, x in held])
    owner = np.repeat(np.arange(len(held)), sizes - WORD_ORDER + 1)
    begins = np.cumsum(sizes) - sizes
    first = np.arange(len(owner)) + (begins - (np.cumsum(sizes - WORD_ORDER + 1) - sizes + WORD_ORDER - 1))[owner]
    key = np.array([k for k, _ in held], np.int64)[owner]
    # In order of their words, which then compress in the shuffle.
    words = [points[first + k].view(np.int64) for k in range(WORD_ORDER)]
    order = np.lexsort(words[::-1])
    words, key = [w[order] for w in words], key[order]
    at = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([w[1:] != w[:-1] for w in words])]))
    m = np.diff(at, append=len(order))
    low, high = np.minimum.reduceat(key, at), np.maximum.reduceat(key, at)
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), *[pa.array(w[at]) for w in words], pa.array(m.astype(np.int64)),
                                       pa.array(low, mask=low != high)], names=["lang", *_PLACES, "m", "only"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[int, np.ndarray]]] = {}
    size: Counter = Counter()
    for lang, key, points in _word_texts(batches):
        held.setdefault(lang, []).append((key, points))
        size[lang] += len(points)
        if size[lang] > WORDS:
            del size[lang]
            yield _word_rows(lang, held.pop(lang))
    for lang, texts in held.items():
        yield _word_rows(lang, texts)


def word_counts(texts: DataFrame, contexts: bool = False) -> DataFrame:
    """(lang, gram, m, only) as of ``gram_counts``, without copies; a gram is a struct of the hashes of its words.

    Rows are dealt by context, so that with ``contexts`` those of ``with_contexts`` need no further shuffle.
    """
    parts = texts.mapInArrow(_count_words, f"lang string, {', '.join(f'{w} long' for w in _PLACES)}, m long, only long")
    counts = parts.repartition("lang", *_PLACES[:-1]).groupBy("lang", *_PLACES).agg(F.sum("m").alias("m"), only_text(*_bounds()))
    if contexts:
        counts = with_contexts(counts, [F.col(w) for w in _PLACES[:-1]], ["m"])
    return counts.select("lang", F.struct(*_PLACES).alias("gram"), *[c for c in counts.columns if c not in ("lang", *_PLACES)])


def _bounds() -> tuple[Column, Column]:
    """Least and largest key of an n-gram that is already a group; any key if several texts have it."""
    return F.coalesce("only", F.lit(-2**63)), F.coalesce("only", F.lit(2**63 - 1))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For the texts with words of a language in a batch: its name, their keys, the hashes of their words and signs, their words
    between signs as places among these, and each n-gram's first place and text."""
    from xxhash import xxh3_64_intdigest

    for batch in slices(batches, "_text", 1 << 23):
        for lang, own in by_language(batch):
            words, codes, sizes = coded_words(own.column("_text"))
            keys, sizes = own.column("_key").to_numpy()[sizes > 0], sizes[sizes > 0]
            if not len(keys):
                continue
            seed = xxh3_64_intdigest(lang.encode())
            # No word is empty or a space.
            hashes = np.array([xxh3_64_intdigest(w, seed) for w in [*words.cast(pa.binary()).to_pylist(), b"", b" "]], np.uint64)
            ends = np.cumsum(sizes + WORD_ORDER)
            line = np.full(ends[-1], len(words))
            line[ends - 1] = len(words) + 1
            line[np.arange(len(codes)) + np.repeat(ends - 1 - np.cumsum(sizes), sizes)] = codes
            first = np.arange(len(codes) + len(keys)) + np.repeat(ends - WORD_ORDER + 1 - np.cumsum(sizes + 1), sizes + 1)
            yield lang, keys, hashes, line, first, np.repeat(np.arange(len(keys)), sizes + 1)


def _packed(arrays: Sequence[np.ndarray]) -> bytes:
    """Whole numbers from 0 on in as few bytes as the largest needs, those of equal weight together, compressed."""
    narrow = [x.astype(np.min_scalar_type(x.max(initial=0))) for x in arrays]
    head = np.array([v for x in narrow for v in (len(x), x.itemsize)], np.int64).tobytes()
    data = head + b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes() for x in narrow)
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpacked(blob: bytes, n: int) -> list[np.ndarray]:
    data = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    at, out = 16 * n, []
    for size, width in np.frombuffer(data, np.int64, 2 * n).reshape(n, 2).tolist():
        rows = np.frombuffer(data, np.uint8, size * width, at).reshape(width, size).T
        out.append(np.ascontiguousarray(rows).view(f"<u{width}").reshape(size))
        at += size * width
    return out


def _pair_part(first: np.ndarray, second: np.ndarray, parts: int) -> np.ndarray:
    mixed = (first * np.uint64(0x9E3779B97F4A7C15)) ^ second
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((mixed >> np.uint64(17)) % np.uint64(parts)).astype(np.int64)


def _middle_part(a: np.ndarray, b: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """The part that scores an n-gram: that of its middle word, of its first two if that is frequent."""
    return np.where(np.isin(b, hot), _pair_part(a, b, parts), (b % np.uint64(parts)).astype(np.int64))


def _last_part(b: np.ndarray, c: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """The part that counts an n-gram: that of its last word, of its last two if that is frequent."""
    return np.where(np.isin(c, hot), _pair_part(b, c, parts), (c % np.uint64(parts)).astype(np.int64))


def dealt_words(texts: DataFrame, hot: np.ndarray, parts: int, turn: int, turns: int, score: bool) -> DataFrame:
    """(lang, part, grams): the n-grams of words of the texts, with text and count, packed for the parts of one turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, keys, hashes, line, first, owner in _lines(batches):
            a, b, c = (line[first + k] for k in range(WORD_ORDER))
            # Frequent words are few, so pairs are only made for n-grams that have one.
            frequent = np.isin(hashes, hot)
            part = (hashes % np.uint64(parts)).astype(np.int64)[b if score else c]
            pairs = np.flatnonzero(frequent[b if score else c])
            part[pairs] = _pair_part(*(hashes[x[pairs]] for x in ((a, b) if score else (b, c))), parts)
            mine = np.flatnonzero(part % turns == turn)
            size = len(hashes)
            # A batch has few enough words and a table few enough parts for 63 bits.
            high, low = (part[mine] * size + b[mine]) * size + c[mine], a[mine] * len(keys) + owner[mine]
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            at = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])[:len(high)])
            counts = np.diff(at, append=len(high))
            high, low = high[at], low[at]
            part, b, c, a, text = high // size // size, high // size % size, high % size, low // len(keys), low % len(keys)
            bounds = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
            place, rows = np.empty(size, np.int64), []
            for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                used, own = np.unique(np.concatenate([a[i:j], b[i:j], c[i:j]])), np.unique(text[i:j])
                place[used] = np.arange(len(used))
                rows.append(_packed([hashes[used], keys[own].view(np.uint64), np.diff(place[b[i:j]], prepend=0), place[c[i:j]], place[a[i:j]],
                                     np.searchsorted(own, text[i:j]), counts[i:j]]))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(part[bounds[:-1]], pa.int32()), pa.array(rows, pa.binary())],
                                             names=["lang", "part", "grams"])

    return texts.mapInArrow(run, "lang string, part int, grams binary")


class _Part:
    """N-grams of words of one part, each once: words as places in ``words``, counts, and the text of those that one text alone has.

    Pairs are the last two words of n-grams; ``pair`` is the place of that of each n-gram, in order.
    """

    def __init__(self, blobs: list[bytes]) -> None:
        # A worker takes one part after the other, so Arrow's spare memory of the last one is handed back.
        pa.default_memory_pool().release_unused()
        made = [_unpacked(x, 7) for x in blobs]
        self.words = np.unique(np.concatenate([x[0] for x in made]))
        size = self.size = len(self.words)
        place = [np.searchsorted(self.words, x[0]) for x in made]
        b, c, a = (np.concatenate([p[x] for p, x in zip(place, xs, strict=True)])
                   for xs in ([np.cumsum(x[2], dtype=np.int64) for x in made], [x[3] for x in made], [x[4] for x in made]))
        self.key = np.concatenate([x[1].astype(np.uint64).view(np.int64)[x[5]] for x in made])
        self.count = np.concatenate([x[6] for x in made]).astype(np.int64)
        del made, place
        c *= size
        c += b
        pairs, back = np.unique(c, return_inverse=True)
        del b, c
        back *= size
        back += a
        grams, self.gram, texts = np.unique(back, return_inverse=True, return_counts=True)
        del a, back
        self.m = np.bincount(self.gram, self.count).astype(np.int64)
        self.single = texts == 1
        key = np.empty(len(grams), np.int64)
        key[self.gram] = self.key
        self.pair, self.first = grams // size, grams % size
        self.second, self.last = pairs % size, pairs // size
        # How many words each pair follows, and the least and largest key of its texts.
        self.n = np.bincount(self.pair)
        starts = np.flatnonzero(np.diff(self.pair, prepend=-1))
        self.low = np.minimum.reduceat(np.where(self.single, key, -2**63), starts)
        self.high = np.maximum.reduceat(np.where(self.single, key, 2**63 - 1), starts)


_COUNTED = "lang string, kind int, v long, w long, n long, single boolean, low long, high long, parts array<int>, t array<long>"


def _lists(group: np.ndarray, value: np.ndarray, groups: int, values: int) -> pa.ListArray:
    """The different values of each group."""
    pairs = np.unique(group * values + value)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs // values, np.arange(groups + 1)), pa.int32()), pa.array(pairs % values, pa.int32()))


def count_parts(dealt: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    """What other parts need of the n-grams of each part, and where they need it.

    Of kind 1, how many words a word ``w`` follows and if one text alone has it; of a frequent word this is one of several
    sums, with the keys of its texts. Of kind 2 the same of pairs (v, w) of a frequent word and the next. Kinds 0 and -1 are how many
    pairs and n-grams have the counts 1 to 4.
    """
    def run(table: pa.Table) -> pa.Table:
        x = _Part(table.column("grams").to_pylist())
        scored = _middle_part(x.words[x.first], x.words[x.second][x.pair], hot, parts)
        starts = np.flatnonzero(np.diff(x.last, prepend=-1))
        low, high = np.minimum.reduceat(x.low, starts), np.maximum.reduceat(x.high, starts)
        last = x.words[x.last[starts]]
        partial = ~np.isin(last, hot)
        word = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(x.last)))[x.pair]
        frequent = np.isin(x.words, hot)[x.second]
        place, mine = np.cumsum(frequent) - 1, frequent[x.pair]
        pairs = int(frequent.sum())

        def rows(size: int, kind: int, **cols: pa.Array) -> pa.Table:
            kinds = pa.array(np.full(size, kind), pa.int32())
            lang = pa.repeat(table.column("lang")[0], size)
            return pa.table([lang, kinds, *[cols.get(f.name, pa.nulls(size, f.type)) for f in schema]], names=["lang", "kind", *schema.names])

        def seen(n: np.ndarray) -> pa.Array:
            return pa.array([np.bincount(np.minimum(n, 5), minlength=6)[1:5]], pa.list_(pa.int64()))

        return pa.concat_tables([
            rows(len(starts), 1, w=pa.array(last.view(np.int64)), n=pa.array(np.diff(starts, append=len(x.last))), single=pa.array(low == high),
                 low=pa.array(low, mask=partial), high=pa.array(high, mask=partial), parts=_lists(word, scored, len(starts), parts)),
            rows(pairs, 2, v=pa.array(x.words[x.second[frequent]].view(np.int64)), w=pa.array(x.words[x.last[frequent]].view(np.int64)),
                 n=pa.array(x.n[frequent]), single=pa.array((x.low == x.high)[frequent]), parts=_lists(place[x.pair[mine]], scored[mine], pairs, parts)),
            rows(1, 0, t=seen(x.n)), rows(1, -1, t=seen(x.m))])

    schema = pa.schema([("v", pa.int64()), ("w", pa.int64()), ("n", pa.int64()), ("single", pa.bool_()), ("low", pa.int64()), ("high", pa.int64()),
                        ("parts", pa.list_(pa.int32())), ("t", pa.list_(pa.int64()))])
    return dealt.groupBy("lang", "part").applyInArrow(run, _COUNTED)


def _kneser_ney(n: np.ndarray, single: np.ndarray, every: np.ndarray, ones: np.ndarray, twos: np.ndarray, kinds: np.ndarray, d: Sequence[float],
                q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability, and the one without the only text that has it, from counts, those of the context, and the lower order; as in ``log_probabilities``."""
    cut = np.take(np.array(d), np.minimum(n, 3) - 1)
    left = d[0] * ones + d[1] * twos + d[2] * (kinds - ones - twos)
    p = (n - cut + left * q) / every
    others = np.maximum(left - cut, min(d))
    return p, np.where(single, np.where(every == n, 1.0, others / np.maximum(every - n, 1)) * r, p)


def score_parts(dealt: DataFrame, known: DataFrame, totals: dict[str, dict[int, Sequence[float]]], contexts: dict[str, dict[int, Sequence[int]]]) -> DataFrame:
    """(_key, total, size): log probability and number of the n-grams that a text has in a part.

    ``known`` are the words and pairs that a part needs, ``totals`` sums and discounts of each language and order,
    ``contexts`` sums over the pairs of a frequent word and the next.
    """
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.float64(), pa.int64())], names=["_key", "total", "size"])
        lang = left.column("lang")[0].as_py()
        x, own, about = _Part(left.column("grams").to_pylist()), totals[lang], contexts.get(lang, {})
        pairs = right.column("v").is_valid().to_numpy()
        w, n, single = (right.column(c).to_numpy() for c in ("w", "n", "single"))
        at = np.searchsorted(x.words, w.view(np.uint64))
        # Order 1.
        every, ones, twos, kinds = own[1][:4]
        last_n, last_single = np.ones(x.size, np.int64), np.zeros(x.size, bool)
        last_n[at[~pairs]], last_single[at[~pairs]] = n[~pairs], single[~pairs]
        q, r = _kneser_ney(last_n, last_single, np.float64(every), ones, twos, kinds, own[1][4:], 1 / kinds, 1 / kinds)
        # Order 2: contexts are whole here but those of frequent words.
        pair_n, pair_single = x.n, x.low == x.high
        sums = [np.bincount(x.second, y, x.size) for y in (pair_n, pair_n == 1, pair_n == 2, np.ones(len(pair_n)))]
        if about:
            v = np.searchsorted(x.words, right.column("v").fill_null(0).to_numpy()[pairs].view(np.uint64))
            spot = np.searchsorted(x.last * x.size + x.second, at[pairs] * x.size + v)
            pair_n, pair_single = pair_n.copy(), pair_single.copy()
            pair_n[spot], pair_single[spot] = n[pairs], single[pairs]
            for word, known_sums in about.items():
                spot = np.searchsorted(x.words, np.int64(word).view(np.uint64))
                if spot < x.size and x.words[spot] == np.int64(word).view(np.uint64):
                    for held, y in zip(sums, known_sums, strict=True):
                        held[spot] = y
        q, r = _kneser_ney(pair_n, pair_single, *[y[x.second] for y in sums], own[2][4:], q[x.last], r[x.last])
        # Order 3: contexts are always whole.
        _, context = np.unique(x.first * x.size + x.second[x.pair], return_inverse=True)
        sums = [np.bincount(context, y)[context] for y in (x.m, x.m == 1, x.m == 2, np.ones(len(x.m)))]
        _, alone = _kneser_ney(x.m, x.single, *sums, own[3][4:], q[x.pair], r[x.pair])
        texts, back = np.unique(x.key, return_inverse=True)
        return pa.table([texts, np.bincount(back, x.count * np.log(alone)[x.gram]), np.bincount(back, x.count).astype(np.int64)], names=["_key", "total", "size"])

    return dealt.groupBy("lang", "part").cogroup(known.groupBy("lang", "part")).applyInArrow(run, "_key long, total double, size long")


def frequent_words(texts: DataFrame, size: int, most: int) -> np.ndarray:
    """Hashes of all words, signs included, that occur more than ``most`` times, and perhaps some that occur half as often."""
    if size <= most:
        return np.array([], np.uint64)
    # What batches leave out is less than half of ``most`` in all: there are fewer of them than this.
    least = max(1, most // (2 * (size // (1 << 21) + 1 + texts.rdd.getNumPartitions())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, hashes, line, _, _ in _lines(batches):
            n = np.bincount(line, minlength=len(hashes))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[n >= least].view(np.int64)), pa.array(n[n >= least])], names=["w", "n"])

    sums = texts.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") > most // 2)
    return np.sort(np.array([x.w for x in sums.collect()], np.int64).view(np.uint64))


def word_scores(texts: DataFrame, part_bytes: int = PART_BYTES, most: int = FREQUENT) -> DataFrame:
    """(_key, word_perplexity) of every different text that has words.

    Texts are read twice in each of a few turns, and a turn moves the n-grams of its parts only, so that no more than these are on
    disk at once: first to where those with the same last word are counted, then to where those with the same
    middle word are scored, since all that a probability needs but the counts of its last word is there. N-grams of a frequent word are
    dealt by two words, so that it is not one task's; the counts of its pairs go where they are needed as well.
    """
    size = texts.agg(F.sum(F.octet_length("_text") + 1)).first()[0] or 0
    hot = frequent_words(texts, size // 2, most)
    parts = size // part_bytes + 1
    turns = min(TURNS, parts)
    counted = reduce(DataFrame.unionByName, [cut_lineage(count_parts(dealt_words(texts, hot, parts, i, turns, score=False), hot, parts)) for i in range(turns)])
    words = counted.where("kind = 1")
    several = cut_lineage(words.where("low IS NOT NULL").groupBy("lang", "w").agg(F.sum("n").alias("n"), (F.min("low") == F.max("high")).alias("single")))
    pairs = counted.where("kind = 2")

    def seen(k: int) -> Column:
        return F.count_if(F.col("n") == k)

    sums = [F.sum("n").alias("all"), seen(1).alias("t1"), seen(2).alias("t2"), F.count("*").alias("kinds")]
    contexts = cut_lineage(pairs.groupBy("lang", "v").agg(*sums))
    firsts = words.where("low IS NULL").select("lang", "n").unionByName(several.select("lang", "n")).groupBy("lang").agg(
        F.lit(1).alias("k"), *sums, seen(3).alias("t3"), seen(4).alias("t4"))
    rest = counted.where("kind < 1").groupBy("lang", (2 - F.col("kind")).alias("k")).agg(*[F.sum(F.col("t")[i]).alias(f"t{i + 1}") for i in range(4)])
    seen_counts = cut_lineage(firsts.unionByName(rest, allowMissingColumns=True))
    discounts = cut_lineage(_estimates(seen_counts.select("k", "lang", "all", "kinds", *[F.col(f"t{i}").cast("double") for i in (1, 2, 3, 4)]), ["all", "t1", "t2", "kinds"]))
    totals: dict[str, dict[int, Sequence[float]]] = {}
    for x in discounts.collect():
        totals.setdefault(x.lang, {})[x.k] = (x["all"], x.t1, x.t2, x.kinds, x.d1, x.d2, x.d3)
    about: dict[str, dict[int, Sequence[int]]] = {}
    for x in contexts.collect():
        about.setdefault(x.lang, {})[x.v] = (x["all"], x.t1, x.t2, x.kinds)
    needed = words.where("low IS NULL").select("lang", F.explode("parts").alias("part"), "v", "w", "n", "single").unionByName(
        pairs.select("lang", F.explode("parts").alias("part"), "v", "w", "n", "single"))
    if len(hot):
        places = words.where("low IS NOT NULL").select("lang", F.explode("parts").alias("part"), "v", "w").distinct()
        needed = needed.unionByName(places.join(F.broadcast(several), ["lang", "w"]).select("lang", "part", "v", "w", "n", "single"))
    scored = [cut_lineage(score_parts(dealt_words(texts, hot, parts, i, turns, score=True), needed.where(F.col("part") % turns == i), totals, about)
                          .groupBy("_key").agg(F.sum("total").alias("total"), F.sum("size").alias("size"))) for i in range(turns)]
    sums = reduce(DataFrame.unionByName, scored).groupBy("_key").agg(F.sum("total").alias("total"), F.sum("size").alias("size"))
    return sums.select("_key", F.round(F.exp(-F.col("total") / F.col("size")), 6).alias("word_perplexity"))


# ------------------------------------------------------- modified Kneser-Ney model

def _discounts(tables: dict[int, DataFrame]) -> DataFrame:
    """(k, lang, d1, d2, d3) from the counts of counts of each order; estimates that cannot be made are 0.5, 1 and 1.5."""
    def seen(k: int) -> Column:
        return F.count_if(F.col("n") == k).cast("double")

    every = reduce(DataFrame.unionByName, [table.select(F.lit(k).alias("k"), "lang", "n") for k, table in tables.items()])
    return _estimates(every.groupBy("k", "lang").agg(*[seen(k).alias(f"t{k}") for k in (1, 2, 3, 4)]))


def _estimates(sums: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """(k, lang, d1, d2, d3) from how many n-grams have the counts 1 to 4, with the columns ``also``."""
    t = {k: F.col(f"t{k}") for k in (1, 2, 3, 4)}
    y = F.try_divide(t[1], t[1] + 2 * t[2])

    def estimate(k: int) -> Column:
        d = k - F.try_divide((k + 1) * y * t[k + 1], t[k])
        return F.when((t[1] > 0) & (t[k] > 0) & (d > 0) & (d < k), d).otherwise(F.lit(k / 2))

    return sums.select("k", "lang", *also, *[estimate(k).alias(f"d{k}") for k in (1, 2, 3)])


def _with_cuts(table: DataFrame, discounts: DataFrame, k: int, n: str, out: str) -> DataFrame:
    """``table`` with the discounts d1 to d3 of order ``k``, and as ``out`` the one of its count ``n``."""
    known = lookup_join(table.drop("d1", "d2", "d3"), discounts.where(F.col("k") == k).drop("k"), ["lang"], ["gram"])
    return known.withColumn(out, F.when(F.col(n) == 1, F.col("d1")).when(F.col(n) == 2, F.col("d2")).otherwise(F.col("d3")))


def _part(first: int, size: int, words: bool) -> Column:
    """``size`` symbols of an n-gram from number ``first`` on."""
    if not words:
        return F.substring("gram", first, size)
    if not size:
        return F.lit("")
    return F.struct(*[F.col(f"gram.{_PLACES[first - 1 + i]}").alias(_PLACES[i]) for i in range(size)])


def with_contexts(counts: DataFrame, context: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """``counts`` with, of the n-grams of the same context, how many kinds there are and, for each count of ``cols``, its sum, ones and twos.

    Sums of discounts follow from these, so that the highest order is not joined with its contexts. A group holds
    the symbols that follow all others of an n-gram.
    """
    alike = Window.partitionBy("lang", *context)
    made = {"kinds": F.count("*").over(alike)}
    for c in cols:
        made |= {f"all_{c}": F.sum(c).over(alike), f"ones_{c}": F.count_if(F.col(c) == 1).over(alike), f"twos_{c}": F.count_if(F.col(c) == 2).over(alike)}
    return counts.withColumns(made)


def log_probabilities(counts: DataFrame, order: int = ORDER, words: bool = False, key: str = "gram") -> DataFrame:
    """(lang, ``key``, logp, alone) of every counted n-gram: interpolated modified Kneser-Ney.

    ``logp`` is over all texts, ``alone`` over the different ones. There an n-gram of a single text
    is taken without its occurrences: its context has those less, and none at all if it had no others.

    ``counts`` comes from ``with_contexts``. An n-gram is ``order`` characters, or a struct of as many words; of the
    highest order only its column ``key`` goes on.
    The highest order uses counts, lower orders the number of different characters that an
    n-gram follows; below the single characters stands the uniform distribution over them.
    Discounts are one row per order and language and are looked up, so that no language is a task.
    Each order is written for the next one but the highest, as large as all others: its rows are read once.
    """
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        longer = tables[k + 1]
        tables[k] = cut_lineage(longer.groupBy("lang", _part(2, k, words).alias("gram")).agg(F.count("*").alias("n"), only_text(*_bounds())))
    # Copies change the counts of the highest order only; its discounts without them are those of order 0.
    discounts = cut_lineage(_discounts({0: counts.select("lang", F.col("m").alias("n")), **tables}))
    lower = None
    for k in range(1, order + 1):
        # Of the key that a group of a lower order needs, only whether it is one is left here.
        table = tables[k].withColumn("single", F.col("only").isNotNull()).drop("only")
        known = _with_cuts(table, discounts, k, "n", "cut")
        if k == order:
            known = known.withColumns({"all": F.col("all_n"), "left": _cuts_of_context("n")})
            joined = _with_cuts(known, discounts, 0, "m", "cut_m").withColumn("left_m", _cuts_of_context("m"))
        else:
            known = known.withColumn("context", _part(1, k - 1, words))
            rest = known.groupBy("lang", "context").agg(F.sum("n").alias("all"), F.sum("cut").alias("left"), F.count("*").alias("kinds"))
            joined = known.join(rest, ["lang", "context"])
        n, cut, every, left = map(F.col, ("m", "cut_m", "all_m", "left_m") if k == order else ("n", "cut", "all", "left"))
        # Sums of discounts are rounded, and never below the least one.
        others = F.greatest(left - cut, F.least("d1", "d2", "d3"))
        without = F.when(every == n, F.lit(1.0)).otherwise(others / (every - n))
        # Either probability is (base + share * lower order) / size; rows carry these three where they meet the lower order.
        own = {"base": F.col("n") - F.col("cut"), "share": F.col("left"), "size": F.col("all"),
               "base_alone": F.when(F.col("single"), F.lit(0.0)).otherwise(n - cut), "share_alone": F.when(F.col("single"), without).otherwise(left),
               "size_alone": F.when(F.col("single"), F.lit(1)).otherwise(every)}
        out = key if k == order else "gram"
        below = [(1 / F.col("kinds")).alias("q"), (1 / F.col("kinds")).alias("r")] if lower is None else [_part(2, k - 1, words).alias("tail")]
        joined = joined.select("lang", out, "single", *[c.alias(name) for name, c in own.items()], *below)
        if lower is not None:
            joined = joined.join(lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("q"), F.col("alone").alias("r")), ["lang", "tail"])
        p = (F.col("base") + F.col("share") * F.col("q")) / F.col("size")
        alone = (F.col("base_alone") + F.col("share_alone") * F.when(F.col("single"), F.col("r")).otherwise(F.col("q"))) / F.col("size_alone")
        lower = joined.select("lang", out, p.alias("p"), alone.alias("alone"))
        lower = lower if k == order else cut_lineage(lower)
    return lower.select("lang", key, F.log("p").alias("logp"), F.log("alone").alias("alone"))


def _cuts_of_context(n: str) -> Column:
    """The sum of the discounts d1 to d3 over an n-gram's context, from how many of its counts are 1, 2 and more."""
    ones, twos = F.col(f"ones_{n}"), F.col(f"twos_{n}")
    return F.col("d1") * ones + F.col("d2") * twos + F.col("d3") * (F.col("kinds") - ones - twos)


def hash_table(model: DataFrame) -> DataFrame:
    """(lang, hash, logp, alone), ``hash`` of the code points of the n-gram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.frombuffer("".join(batch.column(1).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
            h = gram_hash(points, np.arange(0, len(points), ORDER))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h.view(np.int64)), *batch.columns[2:]], names=["lang", "hash", "logp", "alone"])
    return model.select("lang", "gram", "logp", "alone").mapInArrow(run, "lang string, hash long, logp double, alone double")


def sorted_arrays(table: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each language, hashes in order and, as one complex number, both their log probabilities."""
    langs = table.column("lang").to_numpy(zero_copy_only=False)
    hashes, logp = table.column("hash").to_numpy().view(np.uint64), table.column("logp").to_numpy() + 1j * table.column("alone").to_numpy()
    out = {}
    for lang in set(langs):
        own = np.flatnonzero(langs == lang)
        own = own[np.argsort(hashes[own])]
        out[lang] = hashes[own], logp[own]
    return out


# ------------------------------------------------------------------------ features

_SYMBOLS = re.compile(rb"[#*$%&|<>]")


def base_features(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.split()
    # Code points are bytes that do not go on a character.
    chars = int(np.count_nonzero((np.frombuffer(b"".join(words), np.uint8) & 0xC0) != 0x80))
    lines = [x for x in text.split(b"\n") if x.strip()]
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    repeated = 0
    if len(ids) > 3:
        pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
        triples = pairs[:-1] * len(numbers) + ids[2:]
        _, kind, n = np.unique(triples, return_inverse=True, return_counts=True)
        twice = n[kind] > 1
        covered = np.zeros(len(ids), bool)
        for k in range(3):
            covered[k:len(ids) - 2 + k] |= twice
        repeated = int(covered.sum())
    return len(words), chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated


_FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _features(batch: pa.RecordBatch, texts: list[bytes]) -> list[pa.Array]:
    made = [base_features(t) for t in texts]
    return [batch.column("_id"), batch.column("_lang"), batch.column("_key")] + [pa.array(c, pa.int64()) for c in (zip(*made, strict=True) if made else [()] * 5)]


def score_by_arrays(rows: DataFrame, table: DataFrame, id_type: str) -> DataFrame:
    """Features and log probability of every text, with the model in the tasks."""
    model = rows.sparkSession.sparkContext.broadcast(sorted_arrays(table.toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = model.value
        for batch in slices(batches, "_text"):
            texts = batch.column("_text").to_pylist()
            total = np.zeros((2, len(texts)))
            langs = batch.column("_lang").dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                rows = np.flatnonzero(langs.indices.to_numpy() == i)
                words, codes, sizes = coded_words(batch.column("_text").take(pa.array(rows)))
                if not len(codes):
                    continue
                points, first, owner = word_points(words.to_pylist())
                hashes, logp = arrays[lang]
                # Of an empty word, which no text has, nothing is read.
                found = logp[np.minimum(np.searchsorted(hashes, gram_hash(points, first)), len(hashes) - 1)]
                place = rows[np.repeat(np.arange(len(rows)), sizes)]
                for sums, part in zip(total, (found.real, found.imag), strict=True):
                    sums += np.bincount(place, np.bincount(owner, part, len(words))[codes], len(texts))
            yield pa.RecordBatch.from_arrays([*_features(batch, texts), *map(pa.array, total)],
                                             names=["_id", "_lang", "_key", *_FEATURES, "_logp", "_alone"])

    return rows.mapInArrow(run, f"_id {id_type}, _lang string, _key long, {', '.join(f'{f} long' for f in _FEATURES)}, _logp double, _alone double")


def score_by_join(rows: DataFrame, table: DataFrame, id_type: str) -> DataFrame:
    """Features and log probability of every text, by a join of its n-grams with the model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts = batch.column("_text").to_pylist()
            hashes, counts = [], []
            for text in texts:
                words = Counter(decoded_words(text))
                words.pop("", None)
                points, first, owner = word_points(list(words))
                kinds, back = np.unique(gram_hash(points, first), return_inverse=True)
                weight = np.fromiter(words.values(), np.int64, len(words))[owner]
                hashes.append(kinds.view(np.int64))
                counts.append(np.bincount(back, weights=weight, minlength=len(kinds)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*_features(batch, texts), pa.array(hashes, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))],
                names=["_id", "_lang", "_key", *_FEATURES, "_h", "_c"])

    made = rows.mapInArrow(run, f"_id {id_type}, _lang string, _key long, {', '.join(f'{f} long' for f in _FEATURES)}, _h array<long>, _c array<long>")
    made = cut_lineage(made.withColumn("_row", F.monotonically_increasing_id()))
    grams = made.select("_row", F.col("_lang").alias("lang"), F.inline(F.arrays_zip("_h", "_c")))
    sums = grams.join(table.withColumnRenamed("hash", "_h"), ["lang", "_h"]).groupBy("_row").agg(
        *[F.sum(F.col("_c") * F.col(x)).alias(f"_{x}") for x in ("logp", "alone")])
    return made.drop("_h", "_c").join(sums, "_row", "left").drop("_row").fillna(0.0, ["_logp", "_alone"])


def quality(df: DataFrame, id_col: str = "doc_id", lang: str = "lang", text: str = "text", model_bytes: int = MODEL_BYTES,
            width: float = WIDTH) -> DataFrame:
    """Counts, base_failed, perplexity, perplexity_alone, the band of the latter, that of words and kept for every row.

    A missing text has no words and perplexities of 1; a missing language is a language of its
    own. A language none of whose texts pass the base rules has no band and rejects by the base
    rules alone. Repeated rows and ids stay; an empty table gives no rows; other columns are not read.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    texts = different_texts(df, lang, text)
    counts = cut_lineage(with_contexts(gram_counts(texts), [_part(1, ORDER - 1, words=False)], ["n", "m"]))
    table = cut_lineage(hash_table(log_probabilities(counts)))
    rows = df.select(F.col(id_col).alias("_id"), language(lang).alias("_lang"), text_bytes(text).alias("_text")).withColumn("_key", text_key("_lang"))
    small = table.count() * 24 <= model_bytes
    scored = (score_by_arrays if small else score_by_join)(rows, table, id_type)
    symbols = F.col("word_chars") + F.col("n_words")

    def per_symbol(total: str) -> Column:
        return F.round(F.exp(-F.when(symbols > 0, F.col(total) / symbols).otherwise(0.0)), 6)

    scored = cut_lineage(scored.withColumns({
        "perplexity": per_symbol("_logp"), "perplexity_alone": per_symbol("_alone"),
        "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))}))
    scored = cut_lineage(lookup_join(scored, cut_lineage(word_scores(texts)), ["_key"], ["_id"], "left").fillna(1.0, ["word_perplexity"]))
    passing = cut_lineage(scored.where(~F.col("base_failed")).groupBy("_lang", "_key").agg(
        F.log(F.any_value("perplexity_alone")).alias("x"), F.log(F.any_value("word_perplexity")).alias("y")))
    middle = cut_lineage(passing.groupBy("_lang").agg(*[F.percentile_approx(c, 0.5, 10_000).alias(f"m{c}") for c in "xy"]))
    spread = lookup_join(passing, middle, ["_lang"], ["_key"]).groupBy("_lang", "mx", "my").agg(
        *[F.percentile_approx(F.abs(F.col(c) - F.col(f"m{c}")), 0.5, 10_000).alias(f"s{c}") for c in "xy"])
    half, word_half = (F.greatest(F.lit(width * 1.4826) * F.col(c), F.lit(LEAST_WIDTH)) for c in ("sx", "sy"))
    bands = cut_lineage(spread.select("_lang", F.exp(F.col("mx") - half).alias("band_low"), F.exp(F.col("mx") + half).alias("band_high"),
                                      F.exp(F.col("my") + word_half).alias("word_band_high")))
    inside = F.col("perplexity_alone").between(F.col("band_low"), F.col("band_high")) & (F.col("word_perplexity") <= F.col("word_band_high"))
    return lookup_join(scored, bands, ["_lang"], ["_id"], "left").select(
        F.col("_id").alias(id_col), *_FEATURES, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "perplexity", "perplexity_alone",
        "band_low", "band_high", "word_perplexity", "word_band_high")
