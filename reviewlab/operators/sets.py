"""Stacking of tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def stack_positional(dfs: Sequence[DataFrame], names: Sequence[str] | None = None) -> DataFrame:
    """Rows of all tables, columns matched by position, duplicates kept."""
    stacked = reduce(DataFrame.union, dfs)
    return stacked.toDF(*names) if names else stacked


def concat_by_name(dfs: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables, columns matched by name, missing ones NULL, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct_entities(df: DataFrame, row_id: str = "review_id", term: str = "word", kind: str = "type") -> DataFrame:
    """Different (term, type) pairs per text, from one row per mention."""
    return df.select(row_id, term, kind).distinct()
