"""CSV with quoted line breaks, read by as many tasks as its bytes allow.

Whether a line break ends a record depends on all quotes before it in the file: it does if their number
is even, since a quote within a cell is doubled. A split of a file therefore acts on the state
"within quotes" as one of two automata, the one that keeps it or the one that turns it. So

1. each split counts its quotes; the state in which it begins is the product, in file order, of
   those before it, a window over one row per split;
2. each split is read again from its state and gives its whole records;
3. if any split begins within quotes, what splits begin or end within is read as fragments, at most two per split, which
   are joined in file order.

Lines end with LF or CRLF. Quotes are read as RFC 4180 has them: a cell with a quote is quoted, and the
quotes in it are doubled. The state of a split is sent to all tasks as a hash of 8 bytes and a flag.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlab.session import cut_lineage

QUOTE = '"'
WHOLE, OPENS, GOES_ON, CLOSES = range(4)


def read_quoted_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
                    file_columns: Mapping[str, Column] | None = None) -> DataFrame:
    """Records of header CSV files in ``schema``, by position; blank lines are skipped.

    Empty cells, quoted or not, and absent ones are missing values. ``file_columns`` are expressions over
    ``_metadata`` that are constant within a file, such as a number in its name.
    """
    paths = path if isinstance(path, str) else list(path)
    extra = dict(file_columns or {})
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        *[c.alias(n) for n, c in extra.items()])
    lines = lines.withColumn("_split", F.xxhash64("_file", "_start"))
    states = cut_lineage(split_states(lines))
    # 16 bytes per split, whatever the lines: some 13 MB for 100 TB in splits of 128 MB.
    known = lines.drop("_file").join(F.broadcast(states.where("_odd").select("_split", "_odd")), "_split", "left")
    started = known.select("_split", F.coalesce("_odd", F.lit(False)).alias("_odd"), (F.col("_start") == 0).alias("_first"), "value", *extra)
    made = T.StructType([T.StructField("_kind", T.IntegerType()), T.StructField("_split", T.LongType()), T.StructField("_first", T.BooleanType()),
                         T.StructField("value", T.StringType()), *started.select(*extra).schema.fields])
    records = started.mapInArrow(assembler(list(extra), whole=True), made).select("value", *extra)
    if states.where("_odd OR _open").limit(1).count():
        # Only parts of files in which a split begins, or the file ends, within quotes.
        fragments = started.mapInArrow(assembler(list(extra), whole=False), made)
        records = records.unionByName(join_fragments(fragments, states, list(extra)))
    options = {"escape": QUOTE, "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    cells = records.select(F.from_csv("value", ddl, options).alias("_row"), *extra)
    return cells.select(*[F.col("_row")[f.name].alias(f.name) for f in schema.fields], *extra)


def split_states(lines: DataFrame) -> DataFrame:
    """(_split, _file, _start, _odd, _open): whether each split that has lines begins, and its file ends, within quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    counts = lines.groupBy("_file", "_start").agg(F.sum(quotes).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("_n").over(before) % 2 == 1, F.lit(False))
    return counts.select(F.xxhash64("_file", "_start").alias("_split"), "_file", "_start", odd.alias("_odd"),
                         (F.sum("_n").over(Window.partitionBy("_file")) % 2 == 1).alias("_open"))


def join_fragments(fragments: DataFrame, states: DataFrame, extra: Sequence[str]) -> DataFrame:
    """Records that lie in several splits: each from the fragment that opens it to the one that closes it."""
    placed = fragments.join(states.select("_split", "_file", "_start"), "_split")
    # A split closes what it began within before it opens anything.
    order = [F.col("_start"), (F.col("_kind") == OPENS).cast("int")]
    opened = F.sum((F.col("_kind") == OPENS).cast("int")).over(Window.partitionBy("_file").orderBy(*order))
    groups = placed.withColumn("_record", opened).groupBy("_file", "_record")
    pieces = F.sort_array(F.collect_list(F.struct("_start", F.col("_kind") == OPENS, "value")))
    rows = groups.agg(F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("value"), F.max("_first").alias("_first"),
                      *[F.any_value(c).alias(c) for c in extra])
    return rows.where(~F.col("_first")).select(F.regexp_replace("value", "\r$", "").alias("value"), *extra)


class Split:
    """Lines of one split, in order, from the state in which it begins."""

    def __init__(self, key: int, odd: bool, first: bool, extra: dict):
        self.key, self.extra = key, extra
        self.within = odd  # at the begin of the next line
        self.open: list[str] | None = [] if odd else None
        self.inherited = odd  # whether what is open began in an earlier split
        self.header = first

    def _ends(self, lines: pa.Array) -> np.ndarray:
        """Lines that end a record; the state moves on to the line after the last."""
        odd = pc.bit_wise_and(pc.count_substring(lines, QUOTE), 1).to_numpy(zero_copy_only=False).astype(np.int64)
        after = (np.cumsum(odd) + self.within) % 2 == 1
        self.within = bool(after[-1])
        return np.flatnonzero(~after)

    def take(self, lines: pa.Array, whole: bool) -> Iterator[tuple[int, pa.Array, bool]]:
        """Whole records, but for the header, or only the rest of one that began in an earlier split."""
        ends, begin = self._ends(lines), 0
        if not len(ends):
            self.open = (self.open or []) + lines.to_pylist()
            return
        if self.open is not None:
            begin = int(ends[0]) + 1
            text = "\n".join(self.open + lines.slice(0, begin).to_pylist())
            if self.inherited and not whole:
                yield CLOSES, pa.array([text]), False
            if not self.inherited and not self.header and whole:
                yield WHOLE, pa.array([text]), False
            self.header = self.header and self.inherited
            self.open, self.inherited, ends = None, False, ends[1:]
        if len(ends):
            last = int(ends[-1]) + 1
            if whole:
                inner = pa.concat_arrays([lines.slice(begin, last - begin)])
                offsets = pa.array(np.concatenate([[0], ends + 1 - begin]).astype(np.int32))
                records = pc.binary_join(pa.ListArray.from_arrays(offsets, inner), "\n")
                yield WHOLE, records.slice(int(self.header)), False
            self.header, begin = False, last
        if begin < len(lines):
            self.open = lines.slice(begin).to_pylist()

    def finish(self) -> Iterator[tuple[int, pa.Array, bool]]:
        if self.open:
            yield GOES_ON if self.inherited else OPENS, pa.array(["\n".join(self.open)]), self.header and not self.inherited


def assembler(extra: Sequence[str], whole: bool):
    """A function over the lines of a task, which holds one split after the other, that gives whole records or fragments."""

    def batch(split: Split, kind: int, values: pa.Array, first: bool, types: pa.Schema) -> pa.RecordBatch:
        if kind == WHOLE:
            values = pc.replace_substring_regex(values, "\r$", "")
            values = values.filter(pc.not_equal(pc.utf8_trim_whitespace(values), ""))
        n = len(values)
        same = [pa.array([v] * n, types.field(c).type) for c, v in split.extra.items()]
        return pa.record_batch([pa.array([kind] * n, pa.int32()), pa.array([split.key] * n, pa.int64()), pa.array([first] * n, pa.bool_()),
                                values.cast(pa.string()), *same], ["_kind", "_split", "_first", "value", *extra])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, types = None, None
        for rows in batches:
            if not rows.num_rows:
                continue
            types = rows.schema
            keys = rows.column("_split").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if split is None or split.key != int(keys[a]):
                    if split and not whole:
                        yield from (batch(split, *out, types) for out in split.finish())
                    row = rows.slice(a, 1).to_pylist()[0]
                    split = Split(int(keys[a]), row["_odd"], row["_first"], {c: row[c] for c in extra})
                yield from (batch(split, *out, types) for out in split.take(rows.column("value").slice(a, b - a), whole))
        if split and not whole:
            yield from (batch(split, *out, types) for out in split.finish())

    return work
