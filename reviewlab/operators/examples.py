"""Vocabulary tables, encoding by lookup, and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlab import values as v
from reviewlab.operators.filters import seeded_hash
from reviewlab.operators.token_sums import with_token_ids
from reviewlab.scale import dense_index


def build_vocab(tokens: DataFrame, word: str = "word", first_id: int = 0) -> DataFrame:
    """(word, id) of the different words, numbered in their order from ``first_id``."""
    words = tokens.select(F.col(word).alias("word")).where(F.col("word").isNotNull()).distinct()
    numbered = dense_index(words, [F.col("word")], "id")
    return numbered.select("word", (F.col("id") + first_id).cast("int").alias("id"))


def extend_vocab(vocab: DataFrame, tokens: Sequence[str] = v.MASK_TOKENS) -> DataFrame:
    """Append tokens behind the last id; those the vocabulary already holds keep theirs."""
    last = vocab.agg(F.max("id")).scalar()
    listed = vocab.sparkSession.createDataFrame(list(enumerate(dict.fromkeys(tokens), 1)), "at int, word string")
    known = vocab.where(F.col("word").isin(*tokens)).select("word")
    fresh = listed.join(known, "word", "left_anti")
    # The window runs over the listed tokens only.
    ahead = F.row_number().over(Window.orderBy("at"))
    return vocab.unionByName(fresh.select("word", (F.coalesce(last, F.lit(-1)) + ahead).cast("int").alias("id")))


def encode_tokens(df: DataFrame, vocab: DataFrame, cols: Mapping[str, str], unknown: int,
                  row_id: str = "review_id", **scale: int) -> DataFrame:
    """Add id arrays for token columns; ``cols`` maps new column to token column (``token_sums``)."""
    return with_token_ids(df, vocab, {new: F.col(tokens) for new, tokens in cols.items()}, unknown, **scale)


def split_train_test_val(df: DataFrame, test: float = 0.2, val: float = 0.2, seed: int = 42,
                         row_id: str = "review_id", exact: bool = False) -> DataFrame:
    """Add column ``split``: train, test or val.

    By default a row's split depends on its id and the seed alone: no shuffle, stable when
    rows are added, sizes right on average. ``exact`` orders rows by the same hash and cuts
    at exact sizes (rounded up for test and for val).
    """
    digest = seeded_hash(F.col(row_id), seed)
    if not exact:
        h = F.substring(digest, 1, 8)
        first, second = (f"{min(int(share * 16**8), 16**8 - 1):08x}" for share in (test, test + val))
        return df.withColumn("split", F.when(h < first, "test").when(h < second, "val").otherwise("train"))
    keys = df.select(digest.alias("_h"), row_id)
    placed = dense_index(keys, [F.col("_h"), F.col(row_id)], "_at", total="_n")
    n = F.col("_n").cast("double")
    n_test = F.ceil(n * test)
    rest = n - n_test
    n_val = F.ceil(F.coalesce(F.try_divide(n * val, rest), F.lit(0.0)) * rest)

    def key_at(rank: Column, name: str) -> Column:
        return F.min(F.when(F.col("_at") == rank, F.struct("_h", row_id))).alias(name)

    # Rows are compared with the first key of val and of train, so the table is not joined.
    firsts = placed.agg(key_at(n_test, "val"), key_at(n_test + n_val, "train"))
    cuts = firsts.select(F.struct("val", "train").alias("c")).scalar()
    key, val_from, train_from = F.struct(digest.alias("_h"), F.col(row_id)), F.col("_cuts.val"), F.col("_cuts.train")
    split = (F.when(val_from.isNull() | (key < val_from), "test")
             .when(train_from.isNull() | (key < train_from), "val").otherwise("train"))
    return df.withColumn("_cuts", cuts).withColumn("split", split).drop("_cuts")
