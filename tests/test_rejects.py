"""Models that fail on some texts or on all."""

from __future__ import annotations

from pyspark.sql import Observation

from reviewlab.operators.models import encode_texts, score_labels_batch


def picky(word):
    def factory():
        def model(texts):
            if any(word in t for t in texts):
                raise ValueError(f"cannot read {word!r}")
            return [[("x", float(len(t)))] for t in texts]

        return model

    return factory


def test_a_failing_model_gives_counted_rejects(spark):
    df = spark.createDataFrame([(k, "bad" if k % 5 == 0 else None if k % 7 == 0 else f"t{k}") for k in range(40)], "id long, t string").repartition(3)
    counts = Observation()
    rows = {r.id: r for r in score_labels_batch(df, "t", picky("bad"), "s", error="why", counts=counts).collect()}
    assert counts.get == {"rows": 40, "missing": 4, "rejects": 8}
    assert rows[5].s is None and rows[5].why == "ValueError: cannot read 'bad'" and rows[7].s is None and rows[7].why is None
    assert rows[1].s[0].score == 2.0 and rows[1].why is None
    every = Observation()
    all_of = score_labels_batch(df, "t", picky(""), "s", counts=every)
    assert all_of.where("s IS NOT NULL").count() == 0 and every.get["rejects"] == 36


def test_wrong_numbers_of_results_are_rejects(spark):
    def short():
        return lambda texts: [[1.0]] * (len(texts) - 1) if len(texts) > 1 or texts[0] == "b" else [[2.0]]

    df = spark.createDataFrame([(1, "a", "b"), (2, "b", None), (3, "a", "c")], "review_id long, t string, u string")
    for limit in (1 << 30, 0):
        counts = Observation()
        out = encode_texts(df, {"v": "t", "w": "u"}, short, errors={"v": "why"}, counts=counts, limit=limit)
        got = {r.review_id: (r.v, r.w, r.why) for r in out.collect()}
        assert got == {1: ([2.0], None, None), 2: (None, None, "ValueError: 0 results for 1 texts"), 3: ([2.0], [2.0], None)}
        assert counts.get == {"rows": 3, "missing": 0, "rejects": 1} and out.columns == ["review_id", "t", "u", "v", "why", "w"]
