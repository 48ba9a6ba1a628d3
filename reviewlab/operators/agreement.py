"""Agreement of raters: Fleiss' kappa and majority votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fleiss_kappa(ratings: DataFrame, item: str = "item_id", category: str = "category") -> DataFrame:
    """One row with kappa; every item has the same number of ratings (at least two).

    kappa = (P - Pe) / (1 - Pe), where P is the mean share of agreeing rater pairs per item
    and Pe the agreement expected from the category shares.
    """
    cells = ratings.groupBy(item, category).agg(F.count("*").alias("n"))
    per_item = cells.groupBy(item).agg(F.sum("n").alias("raters"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    pairs = F.col("raters") * (F.col("raters") - 1)
    observed = per_item.agg(F.avg(F.try_divide(F.col("squares") - F.col("raters"), pairs)).alias("p"),
                            F.sum("raters").alias("total"))
    shares = cells.groupBy(category).agg(F.sum("n").alias("n")).agg(
        F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    expected = shares.scalar() / (F.col("total").cast("double") * F.col("total"))
    return observed.withColumn("pe", expected).select(
        F.try_divide(F.col("p") - F.col("pe"), 1 - F.col("pe")).alias("kappa"))


def hard_vote(votes: DataFrame, item: str = "item_id", vote: str = "vote") -> DataFrame:
    """Number of items that more than half of the raters accept (votes are 0 or 1)."""
    per_item = votes.groupBy(item).agg(F.sum(vote).alias("yes"), F.count(vote).alias("n"))
    return per_item.agg(F.count_if(F.col("yes") * 2 > F.col("n")).alias("accepted"),
                        F.count("*").alias("items"))
