"""Base rules and the Kneser-Ney model against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from reviewlab.llm import perplexity as pp
from reviewlab.llm.queries import QUERIES
from tests.conftest import SMALL


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if seen[t] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def plain_model(texts):
    """log p of every n-gram of one language, straight from the definition."""
    n = pp.ORDER
    counts = Counter()
    for t in texts:
        for w in re.findall(r"[^\x20\x09-\x0D]+", t or ""):
            s = pp.BEGIN * (n - 1) + w + pp.STOP
            counts.update(s[i:i + n] for i in range(len(s) - n + 1))
    tables = {n: counts}
    for k in range(n - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    cuts = {}
    for k, table in tables.items():
        t = Counter(table.values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else 0
        cuts[k] = []
        for j in (1, 2, 3):
            d = j - (j + 1) * y * t[j + 1] / t[j] if t[1] and t[j] else 0
            cuts[k].append(d if 0 < d < j else j / 2)
    groups = {k: defaultdict(list) for k in tables}
    for k, table in tables.items():
        for g, c in table.items():
            groups[k][g[:-1]].append(c)

    def p(g):
        k = len(g)
        if not k:
            return 1 / len(tables[1])
        own = groups[k][g[:-1]]
        d = lambda c: cuts[k][min(c, 3) - 1]
        return (tables[k][g] - d(tables[k][g])) / sum(own) + sum(map(d, own)) / sum(own) * p(g[1:])
    return {g: math.log(p(g)) for g in counts}


def plain_perplexity(text, model):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    total = symbols = 0
    for w in words:
        s = pp.BEGIN * (pp.ORDER - 1) + w + pp.STOP
        grams = [s[i:i + pp.ORDER] for i in range(len(s) - pp.ORDER + 1)]
        total, symbols = total + sum(model[g] for g in grams), symbols + len(grams)
    return math.exp(-total / symbols) if symbols else 1.0


def check(rows, got):
    models = {x: plain_model([t for _, t, lang in rows if lang == x]) for x in {r[2] for r in rows}}
    want = Counter()
    for i, t, lang in rows:
        base = plain_base(t)
        want[(i, *base, base[0] < 50 or 100 * base[4] > 50 * base[0], round(plain_perplexity(t, models[lang]), 2))] += 1
    assert Counter((r[0], *tuple(r)[1:6], r.base_failed, round(r.perplexity, 2)) for r in got) == want


@pytest.mark.parametrize("model_bytes", [pp.MODEL_BYTES, 0])
def test_rows_of_any_kind(spark, model_bytes):
    body = " ".join(f"{a}{b}é" for a in "abcdefgh" for b in "wxyz 語\U0001f600".split(" ")[0] + "語😀")
    rows = [(1, None, "en"), (2, "", "en"), (3, " \t\n\r\x0b\x0c", "en"), (4, body, "en"), (5, body + " " + body, "en"), (6, body, None),
            (7, "#*$%&|<> a\n\na\nA\n a\nA", "de"), (None, body + "\x1cz\xa0k", "en"), (4, body, "en"), (8, "w " * 30000, "fr"),
            (9, " ".join(f"n{k}" for k in range(5000)), "fr"), (10, "a b c", ""), (11, "one two three four", "x")]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, lang string, n_words int, kept boolean")
    got = pp.quality(df, model_bytes=model_bytes).collect()
    check(rows, got)
    assert all(r.kept is not None for r in got if r.base_failed) and not any(r.kept for r in got if r.base_failed)
    assert pp.quality(df.limit(0), model_bytes=model_bytes).count() == 0


def test_query_against_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = QUERIES["op2_kneser_ney_bands"](spark, SMALL).collect()
    check([(d.doc_id, d.text, d.lang) for d in docs], got)
    assert sum(r.kept for r in got) > 0.9 * sum(not r.base_failed for r in got)
    assert not any(r.kept for r in got if r.base_failed)


def test_band_rejects_what_is_unlike_its_language(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang = 'en'").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10**6, " ".join(f"{chr(33 + k % 90)}{k * 7919 % 9973}{chr(35 + k * 31 % 80)}qz" for k in range(300)), "en")], docs.schema)
    got = {r.doc_id: r for r in pp.quality(docs.union(odd)).collect()}
    assert not got[10**6].kept and not got[10**6].base_failed


def test_copies_do_not_make_gibberish_likely(spark):
    """2 to 1,000 copies of a text of random letters, some of whose words come back, are rejected like one."""
    rnd = random.Random(7)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang = 'en'").select("doc_id", "text", "lang")
    rows, copies = [], {}
    for n in (1, 2, 10, 100, 1000):
        words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randrange(3, 9))) for _ in range(200)]
        text = " ".join(words + [w for w in words[:40] for _ in range(5)])
        copies[n] = len(rows)
        rows += [(10**6 + len(rows) + k, text, "en") for k in range(n)]
    got = {r.doc_id: r for r in pp.quality(docs.union(spark.createDataFrame(rows, docs.schema))).collect()}
    ids = {n: 10**6 + at for n, at in copies.items()}
    assert not any(got[i].base_failed or got[i].kept for i, _, _ in rows)
    assert all(got[i].perplexity_alone > 1.5 * got[i].band_high for i in ids.values())
    clean = [r for i, r in got.items() if i < 10**6 and not r.base_failed]
    assert sum(r.kept for r in clean) > 0.9 * len(clean)


def test_shuffled_words_are_rejected(spark):
    """Texts of known sentences stay; the same words in any order go, with and without copies."""
    rnd = random.Random(11)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randrange(3, 8))) for _ in range(300)]
    sentences = [" ".join(rnd.choices(words, k=12)) for _ in range(200)]
    texts = [" ".join(rnd.sample(sentences, 25)) for _ in range(150)]
    salad = [" ".join(rnd.sample(" ".join(rnd.sample(texts, 50)).split(), 300)) for _ in range(3)]
    rows = [(i, t, "en") for i, t in enumerate([*texts, *salad, *[salad[0]] * 20])]
    got = {r.doc_id: r for r in pp.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows) and not any(r.base_failed for r in got.values())
    assert sum(got[i].kept for i in range(150)) > 0.9 * 150
    odd = [r for i, r in got.items() if i >= 150]
    assert all(r.band_low <= r.perplexity_alone <= r.band_high for r in odd)
    assert not any(r.kept for r in odd)


def test_highest_order_is_handed_on_without_being_written(spark, monkeypatch):
    written, cut = [], pp.cut_lineage
    monkeypatch.setattr(pp, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    texts = spark.createDataFrame([("=en", 1, b"a b c", 1), ("=en", 2, b"a b d", 1), ("=en", 3, b"a b c", 1), ("=fr", 1, b"a b c", 1)],
                                  "lang string, _key long, _text binary, copies long")
    counts = pp.word_counts(texts)
    assert counts.columns == ["lang", "gram", "m", "only"]
    assert Counter((r.lang, r.m, r.only) for r in counts.collect()) == {
        ("=en", 3, None): 2, ("=en", 2, None): 2, ("=en", 1, 2): 2, ("=fr", 1, 1): 4}
    assert pp.word_scores(texts).count() == 3
    # The counts, both lower orders and their probabilities, and discounts.
    assert len(written) == 6


def test_counts_of_words_are_shuffled_once_and_written_by_columns(spark, tmp_path, monkeypatch):
    """Sums over contexts come with the counts: one shuffle, and few bytes an n-gram of random words."""
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(300)]
    rows = [("=en", i, " ".join(rnd.choices(words, k=500)).encode(), 1) for i in range(60)]
    texts = spark.createDataFrame(rows, "lang string, _key long, _text binary, copies long")
    counts = pp.word_counts(texts, contexts=True)
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = counts.collect()
    m = Counter()
    for _, _, text, _ in rows:
        line = ["<", "<", *text.decode().split(), ">"]
        m.update(tuple(line[i:i + 3]) for i in range(len(line) - 2))
    alike = defaultdict(list)
    for g, c in m.items():
        alike[g[:2]].append(c)
    want = Counter((c, len(a), sum(a), a.count(1), a.count(2)) for g, c in m.items() for a in [alike[g[:2]]])
    assert Counter((r.m, r.kinds, r.all_m, r.ones_m, r.twos_m) for r in got) == want
    monkeypatch.setattr(pp, "shared_folder", lambda spark: str(tmp_path))
    assert Counter(map(str, pp.cut_lineage(counts).collect())) == Counter(map(str, got))
    written = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    # A row of a checkpoint has 72 and more.
    assert written < 24 * len(got)


def plain_word_perplexities(texts):
    """Word perplexity of every text of one language, n-grams of one text alone without their occurrences, straight from the definition."""
    lines = [["<", "<", *re.findall(r"[^\x20\x09-\x0D]+", t), ">"] for t in texts]
    grams = [Counter(tuple(x[i:i + 3]) for i in range(len(x) - 2)) for x in lines]
    tables, owners = {3: Counter()}, {k: defaultdict(set) for k in (1, 2, 3)}
    for i, own in enumerate(grams):
        tables[3].update(own)
        for g in own:
            for k in (1, 2, 3):
                owners[k][g[3 - k:]].add(i)
    tables[2] = Counter(g[1:] for g in tables[3])
    tables[1] = Counter(g[1:] for g in tables[2])
    cuts, groups = {}, {k: defaultdict(list) for k in tables}
    for k, table in tables.items():
        t = Counter(table.values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else 0
        ds = [j - (j + 1) * y * t[j + 1] / t[j] if t[1] and t[j] else 0 for j in (1, 2, 3)]
        cuts[k] = [d if 0 < d < j else j / 2 for j, d in enumerate(ds, 1)]
        for g, c in table.items():
            groups[k][g[:-1]].append(c)

    def p(g):
        k = len(g)
        if not k:
            return (1 / len(tables[1]),) * 2
        own, n = groups[k][g[:-1]], tables[k][g]
        cut, left = cuts[k][min(n, 3) - 1], sum(cuts[k][min(c, 3) - 1] for c in own)
        q, r = p(g[1:])
        known = (n - cut + left * q) / sum(own)
        without = 1 if sum(own) == n else max(left - cut, min(cuts[k])) / (sum(own) - n)
        return known, without * r if len(owners[k][g]) == 1 else known
    return [math.exp(-sum(c * math.log(p(g)[1]) for g, c in own.items()) / sum(own.values())) for own in grams]


@pytest.mark.parametrize(("part_bytes", "most"), [(1 << 20, 1 << 20), (700, 1 << 20), (700, 40), (5000, 1)])
def test_word_perplexities_by_parts_against_plain_version(spark, part_bytes, most):
    """One part or many, of middle words or of the first two of frequent ones: every n-gram is counted and scored once."""
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdé語", k=rnd.randrange(1, 4))) for _ in range(60)] + ["the"] * 8
    made = {x: [" \t".join([*rnd.choices(words, k=rnd.randrange(1, 80)), f"{x}{i}"]) for i in range(40)] + ["a b c d", "the", "the the the the the"] for x in ("=en", "-")}
    rows = [(x, 1000 * k + i, t.encode(), 1 + i % 3) for k, x in enumerate(made) for i, t in enumerate(made[x])]
    texts = spark.createDataFrame([*rows, ("=en", -5, b" \n", 1), ("=de", -6, b"", 1)], "lang string, _key long, _text binary, copies long")
    got = {r._key: r.word_perplexity for r in pp.word_scores(texts, part_bytes, most).collect()}
    want = {1000 * k + i: p for k, x in enumerate(made) for i, p in enumerate(plain_word_perplexities(made[x]))}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], p, rel_tol=1e-6, abs_tol=2e-6) for k, p in want.items())


def test_word_model_moves_few_bytes_and_a_turn_its_share(spark, tmp_path, monkeypatch):
    """N-grams of words of random texts: each is dealt in one turn, packed, and little of it stays written."""
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(300)]
    rows = [("=en", i, " ".join(rnd.choices(words, k=500)).encode(), 1) for i in range(60)]
    texts = spark.createDataFrame(rows, "lang string, _key long, _text binary, copies long")
    n, none = sum(501 for _ in rows), pp.frequent_words(texts, 10, 100)
    sizes = [0, 0]
    for score in (False, True):
        turns = [pp.dealt_words(texts, none, 12, i, 4, score).collect() for i in range(4)]
        assert all({r.part % 4 for r in t} == {i} for i, t in enumerate(turns))
        assert sum(int(pp._Part([r.grams]).count.sum()) for t in turns for r in t) == n
        sizes[score] = [sum(len(r.grams) for r in t) for t in turns]
    # Three hashes, a key and a count are 40 bytes.
    assert all(sum(s) < 20 * n and max(s) < 0.45 * sum(s) for s in sizes)
    monkeypatch.setattr(pp, "shared_folder", lambda spark: str(tmp_path))
    assert pp.word_scores(texts).count() == 60
    # The counts of n-grams alone took more than twice that before.
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 4 * n


def test_written_rows_leave_no_setting_behind(spark):
    before = spark.conf.get(pp._CLEANUP, None)
    rows = pp.cut_lineage(spark.range(100).groupBy("id").count())
    assert rows.count() == 100 and spark.conf.get(pp._CLEANUP, None) == before
