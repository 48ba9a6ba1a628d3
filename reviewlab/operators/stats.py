"""Profiles and totals."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from reviewlab import values as v
from reviewlab.scale import exact_quantiles, running_total


def _comparable(df: DataFrame, col: str) -> Column:
    """The column, texts as a 256-bit digest: a distinct count then moves 32 bytes per text."""
    kind = df.schema[col].dataType
    return F.unhex(F.sha2(F.col(col), 256)) if isinstance(kind, StringType) else F.col(col)


def nunique(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct non-NULL values of every column, one row."""
    if approx:
        return df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
    return df.agg(*[F.count_distinct(_comparable(df, c)).alias(c) for c in cols])


def describe(df: DataFrame, col: str) -> DataFrame:
    """One row: count, mean, std, min, exact quartiles, max."""
    x = F.col(col).cast("double")
    basic = df.agg(F.count(col).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                   F.min(x).alias("min"), F.max(x).alias("max"))
    quartiles = exact_quantiles(df, col, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    picked = quartiles.select(F.struct("q25", "q50", "q75").alias("q")).scalar()
    return basic.withColumn("_q", picked).select(
        "count", "mean", "std", "min", "_q.q25", "_q.q50", "_q.q75", "max")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Counts in ``bins`` equal ranges between minimum and maximum; the last is closed."""
    known = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("_x"))
    # A scalar subquery, so the range is computed once and the table is only scanned.
    span = known.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi")).alias("s")).scalar()
    width = (span["hi"] - span["lo"]) / F.lit(bins)
    raw = F.floor(F.coalesce(F.try_divide(F.col("_x") - span["lo"], width), F.lit(0.0)))
    at = F.least(raw, F.lit(bins - 1)).cast("bigint")
    return known.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def auto_bins(df: DataFrame, col: str) -> int:
    """Number of bins from the spread of the values.

    The narrower of two widths is used: range / (log2 n + 1), and 2 * (q75 - q25) / n^(1/3)
    where that is not 0. Whole-number columns get no bins narrower than 1.
    """
    d = describe(df, col).first()
    n, span = d["count"], (d["max"] or 0.0) - (d["min"] or 0.0)
    if not n or not span:
        return 1
    width = span / (math.log2(n) + 1)
    quartiles = 2 * (d["q75"] - d["q25"]) / n ** (1 / 3)
    if quartiles > 0:
        width = min(width, quartiles)
    if isinstance(df.schema[col].dataType, IntegralType):
        width = max(width, 1.0)
    return math.ceil(span / width)


def mean_scores(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean of every score column, one row."""
    return df.agg(*[F.avg(c).alias(c) for c in cols])


def grand_mean(means: DataFrame, cols: Sequence[str], out: str = "grand_mean") -> DataFrame:
    """Mean of the means on a row of ``mean_scores``."""
    total = sum((F.col(c) for c in cols[1:]), start=F.col(cols[0]))
    return means.withColumn(out, total / len(cols))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def count_values(df: DataFrame, col: str) -> DataFrame:
    """Number of different values, a missing value counting once."""
    missing = F.coalesce(F.max(F.col(col).isNull().cast("bigint")), F.lit(0))
    return df.agg((F.count_distinct(_comparable(df, col)) + missing).alias("n"))


def _per_literal(df: DataFrame, literals: Sequence[str], exprs: list[Column], names: list[str]) -> DataFrame:
    # One wide aggregation, turned into a row per literal afterwards: no row of the table
    # is repeated per literal.
    wide = df.agg(F.array(*exprs).alias("_r"))
    return wide.select(F.inline("_r")).select("literal", *names)


def _occurrences(text: Column, literal: str) -> Column:
    """Occurrences of a literal from left to right without overlaps, from what is left without them."""
    if not literal:
        return F.length(text) + 1
    gone = F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))
    return F.when(text.contains(literal), (gone / len(literal)).cast("bigint")).otherwise(F.lit(0))


def literal_profile(df: DataFrame, col: str, literals: Sequence[str] | None = None,
                    names: Sequence[str] = ("rows", "total")) -> DataFrame:
    """For each literal: rows that contain it, and its occurrences over all rows, or one of the two."""
    literals = v.PROFILE_LITERALS if literals is None else literals
    text = F.col(col)

    def measure(name: str, x: str) -> Column:
        if name == "rows":
            return F.count_if(text.contains(x))
        return F.coalesce(F.sum(_occurrences(text, x)), F.lit(0)).cast("bigint")

    exprs = [F.struct(F.lit(x).alias("literal"), *[measure(n, x).alias(n) for n in names]) for x in literals]
    return _per_literal(df, literals, exprs, list(names))


def contains_count(df: DataFrame, col: str, literals: Sequence[str] | None = None) -> DataFrame:
    return literal_profile(df, col, literals, ["rows"])


def substring_total(df: DataFrame, col: str, literals: Sequence[str] | None = None) -> DataFrame:
    return literal_profile(df, col, literals, ["total"])


def regex_row_count(df: DataFrame, col: str, pattern: str = "[a-zA-Z]") -> DataFrame:
    """Rows with at least one match."""
    return df.agg(F.count_if(F.col(col).rlike(pattern)).alias("rows"))


def char_frequency(df: DataFrame, col: str, allowed: str = v.PROFILE_ALLOWED, k: int = 50,
                   by: str = "total") -> DataFrame:
    """Top ``k`` characters outside a class: occurrences and rows that contain them.

    Allowed characters are dropped in runs, and each row reports what is left once per
    character with its number of occurrences, so rows are counted without a distinct count.
    """
    left = df.select(F.regexp_replace(col, f"[{allowed}]+", "").alias("_left")).where(F.col("_left") != "")
    # Sorted, equal characters are runs, which one pass finds.
    ordered = F.array_join(F.array_sort(F.split("_left", "")), "")
    per_row = F.transform(F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*+"), F.lit(0)), lambda run: F.struct(
        F.left(run, F.lit(1)).alias("ch"), F.length(run).alias("n")))
    counts = left.select(F.inline(per_row)).groupBy("ch").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    return counts.orderBy(F.desc(by), "ch").limit(k)


def few_common_labels(df: DataFrame, col: str = "common_emotions", n: int = 6) -> DataFrame:
    """Rows with fewer than ``n`` common labels."""
    return df.agg(F.count_if(F.size(col) < n).alias("rows"))


def any_common_share(df: DataFrame, col: str = "common_emotions") -> DataFrame:
    """Share of rows with at least one common label."""
    return df.agg(F.avg((F.size(col) > 0).cast("double")).alias("share"))


def reply_total(df: DataFrame, store: str = "store", reply: str = "reply", order: str = "review_id") -> DataFrame:
    """Replies per store and their running total, stores in order of first appearance.

    ``order`` is unique over the table. Rows are reduced to one per store first.
    """
    per_store = df.groupBy(store).agg(F.min(order).alias("_first"), F.count(reply).alias("replies"))
    return running_total(per_store, [], [F.col("_first")], F.col("replies"), "running").select(
        store, "replies", "running")


def row_count(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """Rows left after each filter, filters applied one after the other, in one pass."""
    exprs = [F.struct(F.lit("all").alias("stage"), F.count("*").alias("rows"))]
    so_far = F.lit(True)
    for name, predicate in stages.items():
        so_far = so_far & predicate
        exprs.append(F.struct(F.lit(name).alias("stage"), F.count_if(so_far).alias("rows")))
    return df.agg(F.array(*exprs).alias("_r")).select(F.inline("_r"))


def column_extremes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Minimum and maximum per column, one row per column."""
    exprs = [F.struct(F.lit(c).alias("name"), F.min(F.col(c).cast("double")).alias("min"),
                      F.max(F.col(c).cast("double")).alias("max")) for c in cols]
    return df.agg(F.array(*exprs).alias("_r")).select(F.inline("_r"))
