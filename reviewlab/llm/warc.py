"""WARC archives: writing with revisits, and reading by boundary chains.

Archives are read in splits, and a payload may hold what looks like the begin of a record. So
tasks only note candidates: every place of the magic line, with the place where the record
that its header describes would end. Records are those candidates that a chain from the begin
of the file reaches, one record's end being the next one's begin.

* Within a split, the task follows its candidates to where their chains leave the split.
* Between splits, pointers are doubled: after k rounds a pointer spans 2**k splits, and the
  candidates reached from the file's begin are marked on the way.
* Within a split, the chain from the marked candidate is walked once.

Rows in these steps are places, not payloads. A record whose payload holds the magic line
comes in several pieces; only those are read again and put together by their record.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlab.llm.common import text_bytes, whole_text
from reviewlab.scale import cut_lineage, lookup_join

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
STEP = len(MAGIC)
#: The base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


# ------------------------------------------------------------------------ writing

def sha1_base32(data: Column) -> Column:
    """Bare base32 of the SHA-1: five hexadecimal digits are four characters."""
    digest = F.sha1(data)
    out = []
    for k in range(8):
        value = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def _line(name: str, value: Column) -> Column:
    """A header line; breaks in the value become spaces, a missing value has no line."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """A record for every row, under ``path``; rows of one task form an archive.

    Of rows with equal payloads the one of the smallest id is a response that holds the payload,
    as are rows that repeat this id; all others are revisits that refer to it. A missing payload
    is empty, a missing id is above every other one.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url).alias("_url"), whole_text(payload).alias("_body"),
                        sha1_base32(text_bytes(payload)).alias("_digest"))
    light = rows.select("_id", "_digest")
    first = cut_lineage(light.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    known = lookup_join(rows, first, ["_digest"], ["_id"], "left")
    revisit = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    block = F.when(revisit, F.lit("")).otherwise(F.col("_body"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _line("WARC-Record-ID", urn("_id")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"), _line("WARC-Target-URI", F.col("_url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        _line("WARC-Refers-To", F.when(revisit, urn("_first"))), _line("X-Payload-Length", F.octet_length("_body")),
        F.lit("Content-Type: text/html\r\n"), _line("Content-Length", F.octet_length(block)), F.lit("\r\n"), block)
    known.select(record.alias("value")).write.option("lineSep", END).text(path)


# ------------------------------------------------------------------------ reading

_PIECE = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("need", pa.int64()),
    ("leaves", pa.int64()), ("total", pa.int64()), ("whole", pa.bool_()), ("id", pa.string()), ("kind", pa.string()),
    ("digest", pa.string()), ("refers", pa.string()), ("length", pa.int64())])
_PIECE_SQL = ("file string, block long, at long, size long, need long, leaves long, total long, whole boolean, id string, "
              "kind string, digest string, refers string, length long")


def _header(piece: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields after a magic line, and where the block begins; none if there is no length."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = piece[:end].decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines) if sep}
    size = fields.get("content-length", "")
    return (fields, end + 4) if size.isascii() and size.isdigit() and len(size) < 19 else None


def _payload(fields: dict[str, str], block: bytes) -> dict:
    """Fields of a record; length and digest are of the payload itself where the record holds it."""
    kind = fields.get("warc-type", "")
    if kind == "revisit":
        digest, length = fields.get("warc-payload-digest", "").removeprefix("sha1:"), fields.get("x-payload-length", "")
        length = int(length) if length.isascii() and length.isdigit() else None
    else:
        digest, length = base64.b32encode(hashlib.sha1(block).digest()).decode(), len(block)
    bare = lambda x: x.removeprefix("<urn:page:").removesuffix(">")
    return {"id": bare(fields.get("warc-record-id", "")), "kind": kind, "digest": digest,
            "refers": bare(fields.get("warc-refers-to", "")), "length": length}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes, bool]]:
    """(file, block, place of the magic line in the block, bytes after it, last piece of its batch)."""
    last, at = None, 0
    for batch in batches:
        for file, block, value in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            where, data = (file.as_py(), block.as_py()), value.as_py()
            if where != last:
                last, at = where, 0
            yield *where, at - STEP, data
            at += len(data) + STEP


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece, with the end of the chain within the block; one more row for the block's size."""
    rows: list[dict] = []
    where = None

    def close() -> pa.RecordBatch:
        leaves: dict[int, int] = {}
        for row in reversed(rows):
            if row["need"] is not None:
                end = row["at"] + row["need"]
                row["leaves"] = leaves[row["at"]] = leaves.get(end, end)
        total = rows[-1]["at"] + STEP + rows[-1]["size"]
        empty = dict.fromkeys(_PIECE.names)
        return pa.RecordBatch.from_pylist([*({**empty, **r} for r in rows), {**empty, "file": where[0], "block": where[1], "total": total}], _PIECE)

    for file, block, at, data in _pieces(batches):
        if where != (file, block):
            if rows:
                yield close()
            rows, where = [], (file, block)
        row = {"file": file, "block": block, "at": at, "size": len(data) + STEP}
        # Before the first piece of a file stands no magic line.
        head = _header(data) if block or at >= 0 else None
        row["need"] = row["whole"] = None
        if head:
            fields, begin = head
            row["need"] = STEP + begin + int(fields["content-length"]) + len(END)
            row["whole"] = row["need"] == row["size"]
            row |= _payload(fields, data[begin:-len(END)] if row["whole"] else b"")
        rows.append(row)
    if rows:
        yield close()


def _scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary"))


def _walk(table: pa.Table) -> pa.Table:
    """Marks the pieces of one block: ``owner`` is the begin of the record that a piece belongs to."""
    table = table.sort_by("at")
    at, need, entry = table.column("at").to_pylist(), table.column("need").to_pylist(), table.column("entry")[0].as_py()
    owner, now, due = [], None, entry
    for a, n in zip(at, need, strict=True):
        if a == due and n is not None:
            now, due = a, a + n
        owner.append(now)
    return table.drop_columns(["entry"]).append_column("owner", pa.array(owner, pa.int64()))


def _assemble(table: pa.Table) -> pa.Table:
    """One record out of its pieces."""
    table = table.sort_by([("start", "ascending")])
    data = MAGIC.encode().join(table.column("value").to_pylist())
    fields, begin = _header(data)
    made = _payload(fields, data[begin:begin + int(fields["content-length"])])
    return pa.table({k: pa.array([v], _PIECE.field(k).type) for k, v in made.items()})


def _reached(entries: DataFrame) -> DataFrame:
    """Starts of ``entries`` (file, start, next) that pointers from the file's begin reach."""
    reached, jump, n = cut_lineage(entries.where("start = 0").select("file", "start")), entries, -1
    while (count := reached.count()) != n:
        n = count
        ends = reached.join(jump, ["file", "start"]).select("file", F.col("next").alias("start"))
        reached = cut_lineage(reached.union(ends.join(entries, ["file", "start"], "left_semi")).distinct())
        then = jump.select("file", F.col("start").alias("next"), F.col("next").alias("then"))
        jump = cut_lineage(jump.join(then, ["file", "next"]).select("file", "start", F.col("then").alias("next")))
    return reached


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, digest, refers, length) of every record under ``path``.

    Digest and length are computed from the payload of records that hold one, and read from the
    header of revisits. What a chain from its file's begin does not reach is no record. Missing
    ids are empty strings; a folder of empty archives gives no rows.
    """
    pieces = cut_lineage(_scan(spark, path).mapInArrow(_candidates, _PIECE_SQL))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut_lineage(pieces.where("total IS NOT NULL").select(
        "file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")))
    placed = pieces.where("total IS NULL").drop("total").join(bases, ["file", "block"]).withColumn("start", F.col("at") + F.col("base"))
    chains = placed.where("need IS NOT NULL").select("file", "block", "start", "at", (F.col("leaves") + F.col("base")).alias("next"))
    targets = chains.select("file", F.col("next").alias("start")).distinct()
    inner = chains.join(targets, ["file", "start"], "left_semi")
    entries = cut_lineage(inner.union(chains.where("start = 0")).distinct())
    reached = _reached(entries.select("file", "start", "next"))
    marked = entries.join(reached, ["file", "start"], "left_semi").groupBy("file", "block").agg(F.min("at").alias("entry"))
    fields = "id string, kind string, digest string, refers string, length long"
    walked = cut_lineage(placed.join(marked, ["file", "block"], "left").groupBy("file", "block").applyInArrow(
        _walk, f"file string, block long, at long, size long, need long, leaves long, whole boolean, {fields}, base long, start long, owner long"))
    names = ["id", "kind", "digest", "refers", "length"]
    records = walked.where("owner = at")
    broken = records.where("NOT whole").select("file", F.col("start").alias("record"))
    if broken.isEmpty():
        return records.select(*names)
    # Pieces before a block's first record belong to the last record of an earlier block.
    last = walked.groupBy("file", "block").agg(F.max(F.col("owner") + F.col("base")).alias("last"))
    carried = last.select("file", "block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    owned = walked.join(carried, ["file", "block"]).select(
        "file", "block", "at", "start", F.coalesce(F.col("owner") + F.col("base"), F.col("carried")).alias("record"))
    wanted = cut_lineage(owned.join(broken, ["file", "record"], "left_semi"))
    texts = _scan(spark, path).mapInArrow(_piece_bytes, "file string, block long, at long, value binary")
    parts = lookup_join(texts, wanted, ["file", "block", "at"], ["at"])
    put = parts.select("file", "record", "start", "value").groupBy("file", "record").applyInArrow(_assemble, fields)
    return records.where("whole").select(*names).union(put.select(*names))


def _piece_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in _pieces(batches):
        held.append(row)
        size += len(row[3])
        if size > 1 << 24:
            yield _piece_batch(held)
            held, size = [], 0
    if held:
        yield _piece_batch(held)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=["file", "block", "at", "value"])


def archive_and_read(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes ``pages`` to archives and reads them: (id, payload_bytes, payload_digest, record_type, refers_to).

    An empty table gives no rows; repeated rows stay; other columns are not read.
    """
    write_warc(pages, path, id_col, url, payload)
    kind = pages.schema[id_col].dataType
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    return read_warc(pages.sparkSession, path).select(
        number("id").alias(id_col), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), number("refers").alias("refers_to"))
