"""The stages one after the other, each judged on its own input."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from reviewlab.llm.bpe import VOCABULARY, load
from tests.conftest import SMALL
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_suffix_dedup import brute


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SMALL)
    assert clean.columns == columns and 0.8 * docs.count() < clean.count() <= docs.count()
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    near = stages["near duplicates"](spark, docs, SMALL)
    groups = plain_components([plain_fingerprint(r.text) for r in rows], [r.doc_id for r in rows])
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == sorted(set(groups))
    cut = stages["repeats"](spark, docs, SMALL)
    want = {r.doc_id: b for r, b in zip(rows, brute([r.text.encode() for r in rows]), strict=True)}
    got = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == columns and set(got) == {k for k, b in want.items() if b[1] < b[0] or not b[0]}
    assert all(len(got[k].text.encode()) <= want[k][0] - want[k][1] and got[k].n_chars == len(got[k].text) for k in got)
    mixed = stages["mixing"](spark, docs, SMALL)
    assert mixed.columns == columns and set(mixed.collect()) <= set(rows)
    tokens = stages["bpe"](spark, docs, SMALL)
    assert {r.doc_id: r.ids for r in tokens.collect()} == {r.doc_id: load(VOCABULARY).base.encode_ordinary(r.text) for r in rows}


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0 and max(Counter(r.doc_id for r in out.collect()).values()) < 20


def test_repeated_and_missing_ids_keep_one_copy(spark):
    """Through near-dedup and removal of repeats, every clean text is left once and whole."""
    rnd = random.Random(3)
    a, b, c, d, e, f = (" ".join("".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(80)) for _ in range(6))
    rows = [(1, a), (1, a), (1, a), (2, b), (None, b), (None, c), (None, c), (5, d), (5, e), (-4, f), (3, f), (None, f), (3, f), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    want = Counter([(1, a), (2, b), (None, c), (5, d), (5, e), (-4, f), (None, None)])
    assert near.columns == docs.columns and Counter((r.doc_id, r.text) for r in near.collect()) == want
    left = corpus_pipeline.drop_repeats(spark, near, SMALL)
    assert Counter((r.doc_id, r.text or None) for r in left.collect()) == want


#: Names that stages or their operators make on the way.
CLASHES = ("score", "predicted", "held_out", "_features", "_key", "_n", "_row", "_fp", "component_id", "n_removed", "n_bytes", "kept_text", "_spans", "rate",
           "weight", "copy_no", "n_copies", "order_key", "_source", "_who", "_id", "_text", "ids", "n_tokens", "a.b")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:4])
def test_further_columns_stay_as_they_are(spark, name, stage):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    wide = docs.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHES])
    plain, got = stage(spark, docs, SMALL), stage(spark, wide, SMALL)
    rows = got.collect()
    assert got.columns == wide.columns and Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in plain.collect())
    assert all(r[c] == f"{c} {r.doc_id}" for r in rows for c in CLASHES)


def test_last_stage_beside_further_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20)
    wide = docs.select("*", *[F.lit(1).alias(c) for c in CLASHES])
    assert Counter(r.ids_sha256 for r in corpus_pipeline.encode(spark, wide, SMALL).collect()) == \
        Counter(r.ids_sha256 for r in corpus_pipeline.encode(spark, docs, SMALL).collect())


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_of_rows_of_any_kind(spark, name, stage):
    """Missing values, empty and long texts, repeated rows; and no rows at all."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, None, None, "web", None),
            (3, "plain words of a text " * 3, "en", "web", 66), (4, " ".join(f"w{k}" for k in range(60_000)), "en", "web", 400_000)]
    got = stage(spark, spark.createDataFrame(rows, kind), SMALL).collect()
    ids = {r.doc_id for r in got}
    assert ids <= {None, 1, 2, 3, 4} and (name == "mixing" or {3, 4} <= ids) and (name != "bpe" or len(got) == len(rows))
    assert stage(spark, spark.createDataFrame([], kind), SMALL).count() == 0
