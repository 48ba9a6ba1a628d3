"""Tree BPE against the tiktoken library, and round trips."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewlab.llm.bpe import VOCABULARY, TreeBpe, encode_documents, load
from reviewlab.llm.queries import QUERIES
from tests.conftest import SMALL

SIGNS = "ab é 1٣ \t\n  '’!x.ll're\x1c\x85　語😀"


TEST_BPE = TreeBpe(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, part=4, piece=3)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=SIGNS, max_size=120))
def test_small_parts_give_the_same_tokens(text):
    assert TEST_BPE.encode(text).tolist() == TEST_BPE.base.encode_ordinary(text)


@pytest.mark.parametrize("run", ["a", "ab", "é", " ", "\n ", "1", "!", "'s", "thetion", "語"])
def test_long_runs(run):
    bpe = load(VOCABULARY)
    text = run * (9000 // len(run)) + " end"
    assert bpe.encode(text).tolist() == bpe.base.encode_ordinary(text)
    assert bpe.decode(bpe.encode(text)) == text.encode()


def test_random_letters_without_a_break():
    rnd = random.Random(5)
    bpe = load(VOCABULARY)
    text = "".join(rnd.choice("etaoinshrdlu") for _ in range(20000))
    assert bpe.encode(text).tolist() == bpe.base.encode_ordinary(text)
    assert TEST_BPE.encode_piece(text[:3000].encode()) == bpe._alone(text[:3000].encode())


def test_rows_of_any_kind(spark):
    rows = [(1, None, 9), (2, "", 9), (None, "One text's words", 9), (3, "same", 9), (3, "same", 9), (4, "long text " * 30000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(encode_documents(df).collect(), key=str)
    base = load(VOCABULARY).base
    want = sorted(((r[0], len(i), i, hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows
                   for i in [base.encode_ordinary(r[1] or "")]), key=lambda x: str(x[0]))
    assert sorted(((r.doc_id, r.n_tokens, r.ids, r.decoded_sha256) for r in got), key=lambda x: str(x[0])) == want
    assert encode_documents(df.limit(0)).count() == 0


def test_query_against_the_library(spark):
    import numpy as np

    base = load(VOCABULARY).base
    got = {r.doc_id: r for r in QUERIES["op8_tree_bpe"](spark, SMALL).collect()}
    for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = np.array(base.encode_ordinary(d.text), "<u4")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()
