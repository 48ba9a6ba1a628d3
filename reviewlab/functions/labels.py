"""Label sets: threshold, intersection, union, Jaccard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlab import values as v


def threshold_labels(scores: Column, threshold: float = v.LABEL_THRESHOLD) -> Column:
    """Sorted set of labels whose score is above ``threshold`` (strictly)."""
    kept = F.filter(scores, lambda s: s["score"] > F.lit(threshold))
    return F.sort_array(F.array_distinct(F.transform(kept, lambda s: s["label"])))


def common_labels(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_intersect(a, b))


def union_labels(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(a, b))


def label_jaccard(a: Column, b: Column) -> Column:
    """Share of common labels; NULL where both sets are empty, so means skip the row."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))
