"""Quoted CSV in small splits against the csv module."""

from __future__ import annotations

import csv
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlab.sources import quoted_csv, tables

SCHEMA = tables.string_schema(["a", "b", "c"])
CELLS = ["", "plain", "two\nlines", "\n", 'say "hi"', '"', '""\n"', "a,b", " lead ", "long " * 30, "x\n" * 40, "é漢", "crlf\r\nin"]


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def use(size):
        for n, v in zip(names, (size, 0, 1), strict=True):
            spark.conf.set(n, str(v))

    yield use
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def put(path, rows, end="\n", bom=False):
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(["head\nof a", "b", 'c"'])
        out.writerows(rows)


@pytest.mark.parametrize(("seed", "size", "end"), [(0, 40, "\n"), (1, 7, "\n"), (2, 64, "\r\n"), (3, 500, "\r\n"), (4, 1 << 20, "\n")])
def test_records_over_any_splits(spark, tmp_path, small_splits, seed, size, end):
    rnd = random.Random(seed)
    files = [[[f"{k}.{i}", rnd.choice(CELLS), rnd.choice(CELLS)] for i in range(rnd.choice([0, 1, 15]))] for k in range(4)]
    for k, rows in enumerate(files):
        put(f"{tmp_path}/t{k}.csv", rows, end, bom=k % 2 == 0)
    small_splits(size)
    got = tables.read_sharded(spark, str(tmp_path), "t", SCHEMA)
    want = Counter(tuple(c or None for c in row) for rows in files for row in rows)
    assert Counter(map(tuple, got.collect())) == want


def test_one_file_is_read_by_several_tasks(spark, tmp_path, small_splits):
    rows = [[str(i), f"line one of {i}\nline two", 'a "quoted" word'] for i in range(2000)]
    put(f"{tmp_path}/t.csv", rows)
    small_splits(20_000)
    tasks = spark.read.option("lineSep", "\n").text(f"{tmp_path}/t.csv").select(F.spark_partition_id().alias("p")).distinct().count()
    got = tables.read_reviews(spark, f"{tmp_path}/t.csv", SCHEMA)
    assert tasks > 4 and Counter(map(tuple, got.collect())) == Counter(map(tuple, rows))
    states = quoted_csv.split_states(spark.read.option("lineSep", "\n").text(f"{tmp_path}/t.csv").select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")))
    assert states.count() == tasks and 0 < states.where("_odd").count() < tasks


def test_files_are_told_apart(spark, tmp_path, small_splits):
    for i in range(3):
        put(f"{tmp_path}/review_data{i}.csv", [[str(i), "x\ny", "z" * 50]] * 5)
    small_splits(30)
    got = tables.read_numbered(spark, str(tmp_path), 3, SCHEMA)
    assert Counter((r.a, r.b, r.shard) for r in got.collect()) == Counter({(str(i), "x\ny", i): 5 for i in range(3)})


def test_blank_lines_and_short_records(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c\n\n1,2\n   \n"","q",\r\n', encoding="utf-8")
    got = tables.read_reviews(spark, f"{tmp_path}/t.csv", SCHEMA).collect()
    assert Counter(map(tuple, got)) == Counter([("1", "2", None), (None, "q", None)])
    (tmp_path / "none.csv").write_text("", encoding="utf-8")
    assert tables.read_reviews(spark, f"{tmp_path}/none.csv", SCHEMA).count() == 0
