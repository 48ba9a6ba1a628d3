"""What a table holds for the tokens of a text: sums of word vectors or of weights of labels, or ids.

A table measured below a limit is sent to the tasks as one matrix, and the tokens of a row are looked up where the
row is: nothing is shuffled, texts are read once, nothing is joined back. Of a larger table each block of rows gets
the entries of its own words, so no worker holds a table that grows with the input, and no vector moves per token.

The accumulator is a vector of any size, not one aggregate per dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlab.scale import BROADCAST_BYTES, table_bytes
from reviewlab.session import cut_lineage

#: Numbers of gathered vectors that a task holds at once.
CELLS = 1 << 22
#: Tokens and rows, times values per token, of a block of rows: no more values than that are in the entries of its
#: words, nor in what it makes of a token column.
BLOCK_CELLS = 1 << 25
#: A token itself takes the room of so many values.
LEAST_WIDTH = 64
#: Size of a vocabulary that every worker may hold.
WORDS_BYTES = 4 * 1024 * 1024
#: Rows whose tokens are looked up at once.
SLICE = 512


class TokenMatrix:
    """One vector per word; vectors of one word are added up, missing dimensions count nothing."""

    def __init__(self, words: pa.Array, vectors: pa.ListArray, size: int = 0):
        """``size`` is the least number of dimensions."""
        number, known = pd.factorize(words.to_pandas())
        lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        values = np.nan_to_num(vectors.flatten().to_numpy(zero_copy_only=False))
        row = np.repeat(number, lengths)
        place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.words = pa.array(known, pa.string())
        self.matrix = np.zeros((len(known), int(lengths.max(initial=size))), values.dtype if len(values) else float)
        np.add.at(self.matrix, (row, place), values)

    def sums(self, tokens: pa.ListArray) -> pa.ListArray:
        """The sum of each row's known tokens; NULL where none is known."""
        n, size = len(tokens), self.matrix.shape[1]
        found = pc.index_in(tokens.flatten(), value_set=self.words)
        owner = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        known = np.flatnonzero(pc.is_valid(found).to_numpy(zero_copy_only=False))
        owner, rows = owner[known], found.take(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.zeros((n, size))
        step = max(CELLS // max(size, 1), 1)
        for a in range(0, len(rows), step):
            own = owner[a:a + step]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            # A row's tokens may go on in the next step, so what it has is added to.
            total[own[first]] += np.add.reduceat(self.matrix[rows[a:a + step]], first, dtype=float)
        some = np.zeros(n, bool)
        some[owner] = True
        lengths = np.where(some, size, 0)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(total[some].ravel()), mask=pa.array(~some))


def with_token_sums(df: DataFrame, table: DataFrame, texts: Mapping[str, Column],
                    limit: int = BROADCAST_BYTES, tasks: int | None = None) -> DataFrame:
    """Add, for each token column, the sum of the vectors (word, vec) of its known tokens, NULL without any.

    ``texts`` maps new column to token column; equal tokens count as often as they occur.
    """
    if table_bytes(table) <= limit:
        rows = table.select("word", "vec").where(F.col("word").isNotNull()).toArrow()
        return _sums_in_place(df, TokenMatrix(*[c.combine_chunks() for c in rows.columns]), texts)
    return _sums_by_blocks(df, table, texts, tasks)


def _slices(tokens: pa.ListArray) -> Iterator[pa.ListArray]:
    """A batch in parts of few rows: what is made per token is held for one part."""
    for at in range(0, len(tokens), SLICE):
        yield tokens.slice(at, SLICE)


def _sums_in_place(df: DataFrame, matrix: TokenMatrix, texts: Mapping[str, Column]) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(matrix)

    @F.arrow_udf("array<double>")
    def sums(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for tokens in batches:
            yield from map(sent.value.sums, _slices(tokens))

    # So that a filter on a score does not make it twice.
    once = sums.asNondeterministic()
    return df.withColumns({new: once(tokens) for new, tokens in texts.items()})


def _by_blocks(df: DataFrame, table: DataFrame, texts: Mapping[str, Column], tasks: int | None, width: int, kind: str,
               lookup: Callable[[pa.Table], Callable[[pa.ListArray], pa.Array]]) -> DataFrame:
    """Rows are dealt into blocks of about as many tokens and rows; each block gets the entries of its different words, once.

    A word is as often in the join as there are blocks that hold it, so none is hot, and what moves of the table is
    far less than the tokens. A worker holds the tokens of one block and what the table has for them. The rows are
    written out first, numbered, so that a second reading finds the same; ids need not be unique. ``width`` is the
    number of values per entry, ``lookup`` makes the function of token lists from a block's entries.
    """
    rows = cut_lineage(df.withColumn("_n", F.monotonically_increasing_id()))
    columns = {f"_t{i}": tokens for i, tokens in enumerate(texts.values())}
    names = list(columns)
    tokens = rows.select("_n", *[c.alias(t) for t, c in columns.items()])
    every = F.concat(*[F.coalesce(F.col(t), F.array().cast("array<string>")) for t in names])
    # A row without tokens has its place in every column that is made.
    total = tokens.agg(F.sum(F.size(every) + len(names))).first()[0] or 0
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(tasks, -(-total * max(width, LEAST_WIDTH) // BLOCK_CELLS))
    dealt = tokens.withColumn("_block", F.pmod(F.xxhash64("_n"), F.lit(blocks)))
    wanted = dealt.select(F.col("_block").alias("_of"), F.explode(F.array_distinct(every)).alias("word")).distinct()
    entries = wanted.join(table, "word")

    def made(block: pa.Table, found: pa.Table) -> pa.Table:
        look = lookup(found)
        return pa.table([block["_n"], *[look(block[t].combine_chunks()) for t in names]], names=["_n", *names])

    schema = f"_n long, {', '.join(f'{t} {kind}' for t in names)}"
    looked_up = dealt.groupBy("_block").cogroup(entries.groupBy("_of")).applyInArrow(made, schema)
    met = rows.join(looked_up, "_n")
    return met.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(t).alias(new) for t, new in zip(names, texts, strict=True)])


def _sums_by_blocks(df: DataFrame, table: DataFrame, texts: Mapping[str, Column], tasks: int | None) -> DataFrame:
    size = table.agg(F.max(F.size("vec"))).first()[0] or 0
    kind = table.schema["vec"].dataType.elementType
    vec = F.col("vec") if isinstance(kind, T.FloatType | T.DoubleType) else F.col("vec").cast("array<double>")

    def lookup(found: pa.Table) -> Callable[[pa.ListArray], pa.Array]:
        return TokenMatrix(found["word"].combine_chunks(), found["vec"].combine_chunks(), size).sums

    return _by_blocks(df, table.select("word", vec.alias("vec")), texts, tasks, size, "array<double>", lookup)


def _ids_of(words: pa.Array, numbers: pa.Array, unknown: int) -> Callable[[pa.ListArray], pa.ListArray]:
    def ids(tokens: pa.ListArray) -> pa.ListArray:
        found = pc.fill_null(numbers.take(pc.index_in(tokens.flatten(), value_set=words)), unknown)
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), found)

    return ids


def with_token_ids(df: DataFrame, table: DataFrame, texts: Mapping[str, Column], unknown: int,
                   limit: int = WORDS_BYTES, tasks: int | None = None) -> DataFrame:
    """Add, for each token column, the ids that ``table`` (word, id) has for its tokens, in their order.

    A token that the table does not have, or a missing one, has the id ``unknown``; without tokens the list is empty.
    Words are unique in the table. A vocabulary grows with its texts, and every Python worker of an executor holds its
    own copy, so only a small one is sent whole.
    """
    words = table.select("word", F.col("id").cast("int").alias("id")).where(F.col("word").isNotNull())
    if table_bytes(table) > limit:
        def lookup(found: pa.Table) -> Callable[[pa.ListArray], pa.Array]:
            return _ids_of(found["word"].combine_chunks(), found["id"].combine_chunks(), unknown)

        return _by_blocks(df, words, texts, tasks, 1, "array<int>", lookup)
    sent = df.sparkSession.sparkContext.broadcast([c.combine_chunks() for c in words.toArrow().columns])

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        look = _ids_of(*sent.value, unknown)
        for tokens in batches:
            yield from map(look, _slices(tokens))

    return df.withColumns({new: ids(tokens) for new, tokens in texts.items()})
