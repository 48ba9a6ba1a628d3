"""Archives: what is written is read, whatever payloads hold and wherever files are split."""

from __future__ import annotations

import base64
import hashlib
import random
import uuid

import pytest

from reviewlab.llm.queries import QUERIES, SQL
from reviewlab.llm.warc import END, MAGIC, archive_and_read, read_warc, sha1_base32
from reviewlab.session import shared_folder


def fake(body):
    return f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: {len(body)}\r\n\r\n{body}{END}"


PAYLOADS = [None, "", "plain", "plain", "é" * 3000, MAGIC, fake("hello"), "x" + END + fake("hello") + "more", fake("a") + fake("b"),
            END + fake("a") * 30 + "tail", "text " + MAGIC + "Content-Length: 99999999\r\n\r\n", "plain", END, "\r\n", MAGIC * 3,
            "long " * 20000 + MAGIC + "end"]


@pytest.mark.parametrize("split", [None, "700"])
def test_rows_of_any_kind(spark, split):
    rnd = random.Random(2)
    rows = [(k, f"http://x/{k}\r\n{MAGIC}", p, 1) for k, p in enumerate(PAYLOADS)]
    rows += [(100 + k, None, "".join(rnd.choice("ab \r\n") for _ in range(rnd.randrange(900))), 1) for k in range(60)]
    rows += [(None, "u", "plain", 1), (None, "u", "alone", 1), (2, "u", "plain", 1), (3, "u", "plain", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type int").repartition(3)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = archive_and_read(df, f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
        spark.conf.set("spark.sql.files.openCostInBytes", kept[1])
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[2] or ""] = min(r[0], least.get(r[2] or "", r[0]))
    want = []
    for k, _, p, _ in rows:
        body, first = (p or "").encode(), least.get(p or "")
        want.append((k, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if k == first else "revisit",
                     None if k == first else first))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_what_no_chain_reaches_is_no_record(spark):
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    spark.createDataFrame([("noise before " + fake("x"),)], "value string").coalesce(1).write.text(path)
    assert read_warc(spark, path).count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert archive_and_read(df, f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}").count() == 0


def test_base32(spark, value):
    from pyspark.sql import functions as F
    for x in ("", "abc", "é"):
        assert value(sha1_base32(F.col("x").cast("binary")), x=x) == base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()


def test_query_against_sql(spark):
    from checks.compare import differences, open_tables
    from tests.conftest import SMALL
    assert differences(spark, open_tables(SMALL), SMALL, QUERIES["op6_warc_boundary_chain"], SQL["op6_warc_boundary_chain"]) == ""
