"""Pairing of reviews with replies, keyed lookups and attached scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlab.scale import lookup_join, next_in_group


def pair_columns(df: DataFrame, a: str, b: str, row_id: str = "review_id") -> DataFrame:
    """Two columns of the same row, under the row's id."""
    return df.select(row_id, F.col(a).alias("a"), F.col(b).alias("b"))


def pair_turns(turns: DataFrame, group: str = "conv_id", position: str = "turn", role: str = "role",
               text: str = "text", asks: str = "user", answers: str = "assistant",
               unanswered: bool = False) -> DataFrame:
    """A review and the reply that follows it directly: columns review and reply.

    ``unanswered`` also keeps reviews without such a reply, with a NULL reply.
    """
    slim = turns.select(group, position, role, text)
    ahead = next_in_group(slim, group, position, [role, text], keep_last=unanswered)
    answered = F.col(f"next_{role}") == answers
    asked = ahead.where(F.col(role) == asks)
    if not unanswered:
        asked = asked.where(answered)
    return asked.select(group, position, F.col(text).alias("review"),
                        F.when(answered, F.col(f"next_{text}")).alias("reply"))


def lookup_vectors(df: DataFrame, vectors: DataFrame, row_id: Sequence[str], tokens: str = "tokens",
                   **scale: int) -> DataFrame:
    """One row per token occurrence with its vector; unknown tokens are skipped."""
    occurrences = df.select(*row_id, F.posexplode(tokens).alias("pos", "word"))
    return lookup_join(occurrences, vectors, ["word"], [*row_id, "pos"], **scale)


def first_per_key(df: DataFrame, key: str, order: str | Column) -> DataFrame:
    """The row that comes first for each key; a task hands on one row per key."""
    order = F.col(order) if isinstance(order, str) else order
    place = F.row_number().over(Window.partitionBy(key).orderBy(order.asc_nulls_last()))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def exclude_seen_stores(df: DataFrame, seen: DataFrame, store: str = "store",
                        order: str = "review_id") -> DataFrame:
    """First row of each store that is not listed in ``seen``."""
    fresh = df.join(seen.select(store).distinct(), store, "left_anti")
    return first_per_key(fresh, store, order)


def attach_scores(df: DataFrame, scores: DataFrame, key: str = "review_id") -> DataFrame:
    """Add the columns of a score table by row id (unique on both sides)."""
    return df.join(scores, key, "inner")
