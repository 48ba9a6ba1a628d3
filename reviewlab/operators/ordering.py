"""Sorts, extremes, per-store previews, positions and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlab.scale import dense_index, top_rows

#: Rows per group up to which Spark limits a rank before the shuffle.
PER_TASK = 1000


def sort_by_score(df: DataFrame, col: str, row_id: str = "review_id") -> DataFrame:
    return df.orderBy(col, row_id)


def extremes(df: DataFrame, col: str, head: int, tail: int, row_id: str = "review_id") -> DataFrame:
    """Lowest ``head`` and highest ``tail`` rows by a score, marked in column ``side``.

    Two top-k selections; the table is never sorted as a whole.
    """
    known = df.where(F.col(col).isNotNull())
    low = known.orderBy(F.asc(col), F.asc(row_id)).limit(head).withColumn("side", F.lit("head"))
    high = known.orderBy(F.desc(col), F.desc(row_id)).limit(tail).withColumn("side", F.lit("tail"))
    return low.unionByName(high)


def preview_per_store(df: DataFrame, k: int = 10, store: str = "store", order: str = "review_id") -> DataFrame:
    """First ``k`` rows of every store, for a unique ``order``.

    For a small k tasks keep ``k`` rows per store before the shuffle. Beyond what Spark limits in that way, the
    rows of a store are cut by a histogram of ``order``, a number, and numbered in pieces.
    """
    if k > PER_TASK:
        return top_rows(df, store, F.col(order), order, k, "rank").withColumn("rank", F.col("rank").cast("int"))
    first = Window.partitionBy(store).orderBy(order)
    return df.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def store_index(df: DataFrame, store: str = "store", order: str = "review_id") -> DataFrame:
    """Store -> 0-based number in order of first appearance (``order`` is unique)."""
    firsts = df.groupBy(store).agg(F.min(order).alias("_first"))
    return dense_index(firsts, [F.col("_first")], "store_no").select(store, "store_no")


def rank_stores(df: DataFrame, store: str = "store") -> DataFrame:
    """Stores with their number of reviews, most reviewed first."""
    return df.groupBy(store).agg(F.count("*").alias("reviews")).orderBy(F.desc("reviews"), store)


def assign_block(df: DataFrame, n: int, order: str = "review_id") -> DataFrame:
    """Equal blocks in row order: block = position // (rows // n + 1).

    ``order`` is unique. Rows move once, to their range of it, and are numbered there.
    """
    numbered = dense_index(df, [F.col(order)], "_at", total="_rows")
    unit = F.floor(F.col("_rows") / n) + 1
    return numbered.withColumn("block", F.floor(F.col("_at") / unit).cast("bigint")).drop("_at", "_rows")
