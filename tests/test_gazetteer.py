"""Substring masking by automaton and by grams, against one pattern per kind of term."""

from __future__ import annotations

import random
import re

import pytest

from reviewlab import values as v
from reviewlab.operators import gazetteer as gz
from reviewlab.operators.masking import mask_entities


def plain(text: str | None, terms: list[tuple[str, str]]) -> str | None:
    for kind, mask in (("ORGANIZATION", v.ORGANISATION), ("LOCATION", v.PLACE)):
        listed = sorted({t for t, k in terms if k == kind and t and not set(t) & set("#@")}, key=lambda t: (-len(t), t))
        if text is not None and listed:
            text = re.sub("|".join(map(re.escape, listed)), mask, text)
    return text


def check(spark, texts, terms):
    df = spark.createDataFrame(list(enumerate(texts)), "review_id long, t string").repartition(3)
    words = spark.createDataFrame(terms, "term string, type string")
    want = {i: plain(t, terms) for i, t in enumerate(texts)}
    for size in ({"automaton_bytes": 1 << 30}, {"automaton_bytes": 0}, {"automaton_bytes": 0, "limit": 0, "tasks": 5}):
        got = {r.review_id: r.t for r in mask_entities(df, "t", words, **size).collect()}
        assert got == want
    return want


@pytest.mark.parametrize("seed", range(2))
def test_overlapping_terms(spark, seed):
    rnd = random.Random(seed)
    letters = "ab" if seed == 0 else "가나다기관😀x"
    make = lambda n: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, n)))
    terms = [(make(6), rnd.choice(["ORGANIZATION", "LOCATION", "PERSON"])) for _ in range(12)] + [("", "LOCATION"), ("a#b", "LOCATION"), ("a@", "ORGANIZATION")]
    check(spark, [make(60) for _ in range(80)] + [None, "", "a#b", "x" * 5000], terms)


def test_places_inside_the_mask_of_organisations(spark):
    terms = [("bank", "ORGANIZATION"), ("관", "LOCATION"), ("기관x", "LOCATION"), ("bank", "LOCATION"), ("nk b", "LOCATION")]
    want = check(spark, ["a bank and 기관x", "banks 관", "bank bank"], terms)
    assert want[1] == f"#@기{v.PLACE}#s {v.PLACE}"


def test_twenty_thousand_terms(spark):
    terms = [(f"n{k}x", "ORGANIZATION" if k % 2 else "LOCATION") for k in range(20_000)] + [("n7xa", "LOCATION"), ("x", "PERSON")]
    rnd = random.Random(5)
    texts = ["an5199xb n2x, n7xa n7x", "nothing n53000x", "n"] + [" ".join(f"n{rnd.randrange(22_000)}x" for _ in range(50)) for _ in range(40)]
    small = [t for t in terms if any(t[0] in x for x in texts)]
    df = spark.createDataFrame(list(enumerate(texts)), "review_id long, t string")
    words = spark.createDataFrame(terms, "term string, type string")
    want = {i: plain(t, small) for i, t in enumerate(texts)}
    for size in (1 << 30, 0):
        assert {r.review_id: r.t for r in mask_entities(df, "t", words, automaton_bytes=size).collect()} == want


def test_nothing_to_find(spark):
    check(spark, ["a", None], [("zz", "PERSON")])


def test_spans_of_a_long_text():
    finder = gz.Finder([("ab", True, False), ("abc", False, True), ("c", False, True)])
    text = "abc" * 1000
    assert gz.mask_spans(text, finder.spans(text), finder.organisation) == (v.ORGANISATION + v.PLACE) * 1000
