"""Hot keys, global order and lookups on small tables with forced splits."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlab import scale
from reviewlab.operators import examples, filters, ordering, pairing, stats
from reviewlab.operators.models import score_labels


def hot_rows(n=400, seed=1):
    """A third of the rows belongs to one group."""
    r = random.Random(seed)
    return [(i, "hot" if i % 3 == 0 else f"g{r.randint(0, 9)}", r.randint(-5, 5) / 2) for i in range(n)]


@pytest.fixture(scope="module")
def hot(spark):
    return spark.createDataFrame(hot_rows(), "id long, g string, x double").repartition(5)


def test_running_total_of_a_hot_group(hot):
    out = scale.running_total(hot, ["g"], [F.col("id")], F.col("x"), "run", "all").collect()
    seen: dict[str, float] = {}
    for row in sorted(out, key=lambda r: r.id):
        seen[row.g] = seen.get(row.g, 0.0) + row.x
        assert row.run == pytest.approx(seen[row.g])
    assert all(r.all == pytest.approx(seen[r.g]) for r in out)
    assert len(out) == 400


def test_running_total_keeps_rows_without_a_group(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, 2.0), (3, "a", 4.0)], "id long, g string, x double")
    out = scale.running_total(df, ["g"], [F.col("id")], F.col("x"), "run").collect()
    assert {r.id: r.run for r in out} == {1: 1.0, 2: 3.0, 3: 4.0}


def test_position_does_not_depend_on_partitions(hot):
    for n in (1, 7):
        out = scale.dense_index(hot.repartition(n), [F.desc("id")], "at", "n").collect()
        assert all(r.at == 399 - r.id and r.n == 400 for r in out)


@pytest.mark.parametrize("block", [3, 1000])
def test_next_row_of_a_long_group(spark, block):
    r = random.Random(4)
    rows = [(g, p, f"{g}{p}") for g in "abc" for p in sorted(r.sample(range(-20, 90), 40 if g == "a" else 3))]
    df = spark.createDataFrame(rows, "g string, p int, t string").repartition(4)
    want = {}
    for (g, p, _), after in zip(rows, [*rows[1:], (None, 0, None)], strict=True):
        want[g, p] = after[2] if after[0] == g else None
    got = scale.next_in_group(df, "g", "p", ["t"], block).collect()
    assert {(x.g, x.p): x.next_t for x in got} == want and len(got) == len(rows)
    inner = scale.next_in_group(df, "g", "p", ["t"], block, keep_last=False).collect()
    assert {(x.g, x.p): x.next_t for x in inner} == {k: t for k, t in want.items() if t}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_lookup_equals_broadcast_lookup(spark, hot, how):
    hot = hot.unionByName(spark.range(1000, 1300).select("id", F.lit(None).cast("string").alias("g"), F.lit(0.0).alias("x")))
    table = spark.createDataFrame([("hot", 1), ("hot", 2), ("g1", 3), ("g2", 4), ("no", 5)], "g string, y int")
    a = scale.lookup_join(hot, table, ["g"], ["id"], how)
    b = scale.lookup_join(hot, table, ["g"], ["id"], how, limit=0, tasks=5)
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_hot_key_is_spread_over_salts(spark, hot):
    table = spark.createDataFrame([("hot", 1), ("g1", 3)], "g string, y int")
    plan = scale.lookup_join(hot, table, ["g"], ["id"], limit=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_keys_are_salted_by_their_weight(spark):
    weights = {"a": 500, "b": 250, "c": 60, "d": 20}
    rows = [(k, i) for k, n in weights.items() for i in range(n)] + [(f"x{i}", i) for i in range(170)]
    df = spark.createDataFrame(rows, "g string, id long")
    names = {r.h: r.g for r in df.select("g", F.xxhash64("g").alias("h")).distinct().collect()}
    salts = {names[h]: n for h, n in scale.hot_keys(df, ["g"], 20).items()}
    assert salts == {"a": 10, "b": 5, "c": 2}
    assert all(weights[g] / n <= len(rows) / 20 for g, n in salts.items())


def test_join_of_hot_keys_of_other_types_and_without_a_key(spark):
    df = spark.createDataFrame([(None if i % 5 == 0 else 7 if i % 2 else i, i) for i in range(300)], "k int, id long")
    table = spark.createDataFrame([(7, "hot"), (7, "again"), (8, "x"), (2**40, "none"), (None, "null")], "k long, v string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = Counter(map(tuple, df.join(table, "k", how).collect()))
        assert Counter(map(tuple, scale.lookup_join(df, table, ["k"], ["id"], how, limit=0, tasks=6).collect())) == plain
    assert None in scale.hot_keys(df, ["k"], 6) and scale.hot_keys(df.limit(0), ["k"], 6) == {}


def test_table_bytes_grows_with_the_rows(spark):
    df = spark.range(100).select(F.lit("abcd").alias("s"), F.array(F.lit(1.0), F.lit(2.0)).alias("a"), "id")
    assert scale.table_bytes(df) == 100 * (20 + 32 + 8)
    assert scale.table_bytes(df.limit(0)) == 0


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_quantiles_equal_numpy(spark, n):
    r = random.Random(n)
    values = [0.5 if r.random() < 0.35 else r.gauss(0, 100) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = scale.exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.75, 1.0], list("abcde")).first()
    assert list(got) == pytest.approx(list(np.quantile(values, [0.0, 0.25, 0.5, 0.75, 1.0])))


def test_quantiles_with_brackets_that_fail(spark, monkeypatch):
    monkeypatch.setattr(scale, "ACCURACY", 2)
    df = spark.range(1001).select((F.col("id") * 3 % 1001).cast("double").alias("x"))
    assert scale.exact_quantiles(df, "x", [0.1, 0.5], ["a", "b"]).first() == (100.0, 500.0)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "x double")
    assert scale.exact_quantiles(empty, "x", [0.5], ["a"]).first() == (None,)
    assert stats.describe(empty, "x").first()["count"] == 0


def test_describe_of_one_value(spark):
    got = stats.describe(spark.createDataFrame([(2,), (None,)], "x int"), "x").first()
    assert (got["count"], got["mean"], got["std"], got["q50"]) == (1, 2.0, None, 2.0)


def test_histogram_of_equal_values_and_edges(spark):
    same = stats.histogram(spark.createDataFrame([(1.0,), (1.0,), (None,)], "x double"), "x", 4)
    assert [tuple(r) for r in same.collect()] == [(0, 2)]
    edges = stats.histogram(spark.createDataFrame([(float(i),) for i in range(11)], "x double"), "x", 5)
    assert sorted(tuple(r) for r in edges.collect()) == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 3)]


def test_bins_equal_numpy(spark):
    r = random.Random(3)
    for kind, values in (("double", [r.gauss(0, 3) for _ in range(500)]), ("long", [r.randint(0, 12) for _ in range(300)]),
                         ("double", [1.0] * 20)):
        df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
        assert stats.auto_bins(df, "x") == len(np.histogram_bin_edges(np.array(values), "auto")) - 1
    # Equal quartiles: only the number of rows counts (numpy changed this case over its versions).
    flat = spark.createDataFrame([(0.0,)] * 90 + [(1.0,)] * 10, "x double")
    assert stats.auto_bins(flat, "x") == math.ceil(math.log2(100) + 1)


def test_store_order_and_totals(spark):
    rows = [(5, "b", "x"), (1, "c", None), (3, "b", "y"), (2, "a", "z"), (4, "c", "w")]
    df = spark.createDataFrame(rows, "review_id long, store string, reply string")
    assert {r.store: r.store_no for r in ordering.store_index(df).collect()} == {"c": 0, "a": 1, "b": 2}
    totals = {r.store: (r.replies, r.running) for r in stats.reply_total(df).collect()}
    assert totals == {"c": (1, 1), "a": (1, 2), "b": (2, 4)}
    assert [r.store for r in ordering.rank_stores(df).collect()] == ["b", "c", "a"]


def test_blocks_are_equal_and_in_order(spark):
    df = spark.range(103).select((F.col("id") * 7).alias("review_id"))
    blocks = {r.review_id // 7: r.block for r in ordering.assign_block(df, 10).collect()}
    assert blocks == {i: i // 11 for i in range(103)}


def test_reply_ratio_uses_whole_division(spark):
    rows = [(i, "few", "r" if i == 0 else None) for i in range(19)] + [(i + 20, "none", None) for i in range(10)]
    df = spark.createDataFrame(rows, "review_id long, store string, reply string")
    assert {r.store for r in filters.reply_ratio_filter(df, ["review_id"]).collect()} == {"few"}


def test_first_row_of_unseen_stores(spark):
    rows = [(3, "a", "x"), (1, "a", "y"), (2, "b", "z"), (4, "c", None)]
    df = spark.createDataFrame(rows, "review_id long, store string, reply string")
    seen = spark.createDataFrame([("b",), ("b",)], "store string")
    got = pairing.exclude_seen_stores(df, seen)
    assert sorted(tuple(r) for r in got.select("store", "review_id").collect()) == [("a", 1), ("c", 4)]


def test_texts_without_tokens_keep_their_row(spark):
    lexicon = spark.createDataFrame([("joy", "yes", 3.0), ("anger", "no", 1.0)], "label string, token string, weight double")
    df = spark.createDataFrame([(1, "Yes yes"), (2, ""), (3, None)], "review_id long, t string")
    for limit in (1 << 20, 0):
        got = {r.review_id: {s.label: round(s.score, 4) for s in r.s}
               for r in score_labels(df, {"s": "t"}, lexicon, -1.0, limit=limit).collect()}
        assert got == {1: {"joy": 0.9933, "anger": 0.2689}, 2: {"joy": 0.2689, "anger": 0.2689},
                       3: {"joy": 0.2689, "anger": 0.2689}}


def test_split_sizes(spark):
    df = spark.range(1003).withColumnRenamed("id", "review_id")
    for exact in (False, True):
        counts = {r.split: r["count"] for r in
                  examples.split_train_test_val(df, exact=exact).groupBy("split").count().collect()}
        assert sum(counts.values()) == 1003
        if exact:
            assert counts == {"test": 201, "val": 201, "train": 601}
        else:
            assert counts["train"] > 550
    once = {r.review_id: r.split for r in examples.split_train_test_val(df).collect()}
    again = {r.review_id: r.split for r in examples.split_train_test_val(df.repartition(9)).collect()}
    assert once == again


@pytest.mark.parametrize("k", [1, 7, 150, 5000])
def test_top_rows_of_any_number(spark, k):
    rnd = random.Random(k)
    rows = [(None if rnd.random() < 0.05 else "hot" if i % 3 else f"g{i % 40}", rnd.choice([None, 0.0, 1e9, float(rnd.randrange(50))]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, s double, t long").repartition(6)
    want = {}
    for g in {r[0] for r in rows}:
        ranked = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0.0, r[2]))
        want |= {r[2]: at for at, r in enumerate(ranked[:k], 1)}
    for limit in (1 << 20, 0):
        got = scale.top_rows(df, "g", F.col("s"), "t", k, "at", limit=limit)
        assert got.columns == ["g", "s", "t", "at"] and {r.t: r["at"] for r in got.collect()} == want


def test_previews_of_more_rows_than_a_rank_is_limited_to(spark, monkeypatch):
    df = spark.range(400).select(F.col("id").alias("review_id"), F.when(F.col("id") % 4 > 0, "hot").otherwise("b").alias("store"))
    plain = {(r.store, r.review_id, r.rank) for r in ordering.preview_per_store(df, 120).collect()}
    monkeypatch.setattr(ordering, "PER_TASK", 50)
    assert {(r.store, r.review_id, r.rank) for r in ordering.preview_per_store(df, 120).collect()} == plain and len(plain) == 220


def test_blocks_are_placed_without_collecting(spark):
    plan = ordering.assign_block(spark.range(50).withColumnRenamed("id", "review_id"), 4)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Exchange rangepartitioning" not in plan
