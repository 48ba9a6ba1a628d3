"""Files, pages and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlab import values as v
from reviewlab.sources import pages, tables
from reviewlab.streaming import incremental

NASTY = [("Cafe \"X\", A", "5", None, "3", "a\nb", v.GUEST_ID, " lead, trail ", "line one\n\nline \"two\" \\ end"),
         ("b", "1", "2", "3", "", "u**님", "x\ty", "'")]


@pytest.mark.parametrize("shards", [1, 2])
def test_csv_round_trip(spark, tmp_path, shards):
    df = spark.createDataFrame(NASTY, tables.REVIEW_SCHEMA).repartition(shards)
    tables.write_reviews(df, f"{tmp_path}/t")
    back = tables.read_reviews(spark, f"{tmp_path}/t").collect()
    # An empty text comes back as a missing one.
    want = [tuple(x or None for x in row) for row in NASTY]
    assert sorted(map(tuple, back), key=str) == sorted(want, key=str)


def test_csv_with_byte_order_mark_and_line_breaks(spark, tmp_path):
    header = ",".join(["업체명", "맛", "양", "배달", "주문메뉴", "고객id", "고객리뷰", "사장답글"])
    body = '가게,5,4,3,"a\nb",u**님,"say ""hi""",끝\n'
    (tmp_path / "review_data0.csv").write_bytes(f"{header}\n{body}".encode("utf-8-sig"))
    (tmp_path / "review_data1.csv").write_bytes(f"{header}\n둘,1,1,1,m,c,r,a\n".encode())
    (tmp_path / "other.csv").write_bytes(b"x\n1\n")
    first = tables.read_reviews(spark, f"{tmp_path}/review_data0.csv").first()
    assert (first.store, first.menu, first.review) == ("가게", "a\nb", 'say "hi"')
    assert tables.read_sharded(spark, str(tmp_path), "review").count() == 2
    numbered = {r.store: r.shard for r in tables.read_numbered(spark, str(tmp_path), 2).collect()}
    assert numbered == {"가게": 0, "둘": 1}


def test_word_vectors_skip_the_header(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 3\nhello 0.5 1e-3 -2\n가게 1 2 3\n", encoding="utf-8")
    got = {r.word: r.vec for r in tables.read_word_vectors(spark, f"{tmp_path}/v.txt").collect()}
    assert got["hello"] == pytest.approx([0.5, 0.001, -2]) and got["가게"] == [1, 2, 3]


def test_one_split_reads_its_folder_only(spark, tmp_path):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 7, "train").otherwise("val"))
    tables.write_columnar(df, f"{tmp_path}/c")
    train = tables.read_columnar(spark, f"{tmp_path}/c", "train")
    assert train.count() == 7 and tables.read_columnar(spark, f"{tmp_path}/c").count() == 10
    assert "PartitionFilters: [isnotnull(split" in train._jdf.queryExecution().toString()


def block(reply, **stars):
    parts = "".join(f'<span class="points ng-binding" ng-show="review.rating_{k} &gt; 0">{n}</span>'.replace("&gt;", ">")
                    for k, n in stars.items())
    answer = f'<p class="ng-binding" ng-bind-html="review.owner_reply.comment|strip_html"> {reply} </p>' if reply else ""
    return ('<li class="list-group-item star-point ng-scope" ng-repeat="review in restaurant.reviews">'
            f'<span ng-show="review.phone" class="review-id ng-binding">aa**님</span>{parts}'
            f'<p class="ng-binding" ng-show="review.comment">so &lt;good&gt;</p>{answer}</li>')


def test_review_page(spark):
    html = ('<html><span class="restaurant-name ng-binding">Cafe &amp; Co</span><ul>'
            + block("thanks", taste=5, quantity=4) + block(None, taste=1) + block("again", delivery=2) + "</ul></html>")
    got = pages.extract_reviews(spark.createDataFrame([(1, html), (2, "<html></html>")], "page_id long, html string"))
    rows = [tuple(r) for r in got.orderBy("at").select("store", "taste", "quantity", "delivery", "menu", "customer_id",
                                                       "review", "reply").collect()]
    assert rows == [("Cafe & Co", "5", "4", v.NO_RATING, v.NO_MENU, "aa**님", "so <good>", "thanks"),
                    ("Cafe & Co", v.NO_RATING, v.NO_RATING, "2", v.NO_MENU, "aa**님", "so <good>", "again")]


def test_store_list(spark):
    html = "".join(f'<div><div class="restaurant-name ng-binding" ng-bind="x">{n}</div>9</div>' for n in ("A &amp; B", "C"))
    got = pages.extract_stores(spark.createDataFrame([(1, f"<body>{html}</body>")], "page_id long, html string"))
    assert sorted((r.at, r.store) for r in got.collect()) == [(0, "A & B"), (1, "C")]


EVENT = T.StructType([T.StructField("store", T.StringType()), T.StructField("reply", T.StringType())])


def put(spark, folder, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(folder)


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    source, keys, totals = (f"{tmp_path}/{x}" for x in ("in", "keys", "totals"))
    seen = spark.createDataFrame([("old",)], "store string")

    def run():
        stream = incremental.stream_files(spark, source, EVENT, files_per_batch=1)
        incremental.append_available(incremental.stream_new_keys(stream, "store", seen), keys, f"{keys}-state")
        incremental.update_available(incremental.stream_reply_total(stream, "store", "reply"), totals, f"{totals}-state")
        return (sorted(r.store for r in spark.read.schema("store string").parquet(keys).collect()),
                {r.store: r.replies for r in incremental.latest(spark, totals, "store", "replies").collect()})

    put(spark, source, [("a", "x"), ("old", "y"), ("a", None)])
    put(spark, source, [("b", None), ("a", "z")])
    assert run() == (["a", "b"], {"a": 2, "b": 0, "old": 1})
    put(spark, source, [("b", "x"), ("c", "y")])
    assert run() == (["a", "b", "c"], {"a": 2, "b": 1, "old": 1, "c": 1})


def test_state_store_on_disk(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    incremental.keep_state_on_disk(spark)
    try:
        put(spark, f"{tmp_path}/in", [("a", "x"), ("a", "y")])
        stream = incremental.stream_files(spark, f"{tmp_path}/in", EVENT)
        incremental.append_available(incremental.stream_new_keys(stream, "store"), f"{tmp_path}/k", f"{tmp_path}/s")
        assert spark.read.parquet(f"{tmp_path}/k").count() == 1
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
