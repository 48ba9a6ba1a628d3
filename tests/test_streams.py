"""Tables that grow by micro-batches."""

from __future__ import annotations

import os

from pyspark.sql import types as T

from reviewlab.streaming import incremental
from reviewlab.streaming.keyed_log import KeyedLog, last_value, once, sum_of

EVENT = T.StructType([T.StructField("store", T.StringType()), T.StructField("reply", T.StringType())])


def put(spark, folder, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(folder)


def folders(path, prefix="epoch="):
    return sorted(int(n[len(prefix):]) for n in os.listdir(path) if n.startswith(prefix)) if os.path.isdir(path) else []


def test_new_keys_over_many_batches(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/keys"
    seen = spark.createDataFrame([("old",), (None,)], "store string").where("store = 'old'")

    def run():
        stream = incremental.stream_files(spark, source, EVENT, files_per_batch=1)
        incremental.append_new_keys(stream, "store", path, f"{path}-state", seen, every=2)
        return sorted((r.store for r in incremental.new_keys(spark, path, "store").collect()), key=str)

    for k in range(5):
        put(spark, source, [("a", "x"), ("old", "y"), (f"s{k}", None), (f"s{k - 2}", None), (None, "n")])
    want = ["None", "a", "s-1", "s-2", *[f"s{k}" for k in range(5)]]
    assert list(map(str, run())) == sorted(want)
    put(spark, source, [("b", "x"), ("s0", "x")])
    assert list(map(str, run())) == sorted([*want, "b"])
    log = KeyedLog(spark, path, "store", once("store"))
    # The stream keeps no state; of six batches, no more than a base and two generations of epochs are left.
    assert log.merged_upto() == 3 and log.epochs() == [4, 5] and folders(path) == [2, 3, 4, 5] and folders(f"{path}/base", "upto-") == [1, 3]
    assert not os.path.exists(f"{path}-state/state")


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    log = KeyedLog(spark, f"{tmp_path}/log", "k", sum_of("k", "n"), every=2)
    batch = lambda *rows: spark.createDataFrame(list(rows), "k string, n long")
    totals = lambda: {r.k: r.n for r in log.read().collect()}
    assert log.read() is None
    for epoch, rows in enumerate([[("a", 1)], [("a", 2), ("b", 5)], [("c", 1)], [("a", 4)], [("b", 1)]]):
        log.write(batch(*rows), epoch)
        before = totals()
        log.write(batch(*rows), epoch)
        assert totals() == before
    assert totals() == {"a": 7, "b": 6, "c": 1} and log.merged_upto() == 3 and log.epochs() == [4]
    files = log.rows().inputFiles()
    assert all("/base/upto-3/" in f or "/epoch=4/" in f for f in files)


def test_a_base_without_its_manifest_is_not_read(spark, tmp_path):
    log = KeyedLog(spark, f"{tmp_path}/log", "k", last_value("k", "n"), every=100)
    for epoch in range(3):
        log.write(spark.createDataFrame([("a", epoch), (f"b{epoch}", 7)], "k string, n int"), epoch)
    spark.createDataFrame([("a", 99, 0)], "k string, n int, _part int").write.parquet(f"{tmp_path}/log/base/upto-1")
    os.makedirs(f"{tmp_path}/log/epoch=9")
    assert {r.k: r.n for r in log.read().collect()} == {"a": 2, "b0": 7, "b1": 7, "b2": 7}
    assert log.rows(before=1).count() == 2 and log.rows(parts=[]).count() == 0


def test_batches_without_rows(spark, tmp_path):
    log = KeyedLog(spark, f"{tmp_path}/log", "k", sum_of("k", "n"), every=2)
    for epoch in range(5):
        log.write(spark.createDataFrame([("a", 3)] if epoch == 4 else [], "k string, n long"), epoch)
        assert {r.k: r.n for r in log.read().collect()} == ({"a": 3} if epoch == 4 else {})
    assert log.merged_upto() == 3


def test_totals_without_a_state(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/totals"
    for rows in ([("a", "x"), ("b", None)], [("a", "y"), ("a", None)], [("c", None)]):
        put(spark, source, rows)
    stream = incremental.stream_files(spark, source, EVENT, files_per_batch=1)
    incremental.add_reply_totals(stream, "store", "reply", path, f"{path}-state", every=2)
    assert {r.store: r.replies for r in incremental.reply_totals(spark, path, "store").collect()} == {"a": 2, "b": 0, "c": 0}
    assert KeyedLog(spark, path, "store", sum_of("store", "replies")).merged_upto() == 1
