"""Filtering and sampling of scored candidates, one group per decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlab.operators.ordering import PER_TASK
from reviewlab.scale import lookup_join, running_total, top_rows
from reviewlab.session import cut_lineage


def nucleus_filter(df: DataFrame, group: str = "grp", token: str = "token", score: str = "score",
                   top_k: int = 0, top_p: float = 0.0, temperature: float = 1.0, renormalise: bool = True,
                   **scale: int) -> DataFrame:
    """Candidates that survive top-k and nucleus filtering, with their probability.

    Scores are divided by the temperature. Top-k keeps candidates tied with the k-th.
    Going down by score, a candidate stays while the probability summed up before it is
    not above ``top_p``; the first always stays. 0 switches a filter off. ``token`` is
    unique within a group. ``prob`` is the share among the kept candidates; without
    ``renormalise`` the share among those the nucleus is cut from, which takes one pass
    less and is all that a draw needs.

    Groups and top-k may be of any size: the k-th score is looked up where it is beyond what a rank is limited to
    per task (``scale.top_rows``), the groups' largest score and kept mass are looked up, and the
    running total is taken over pieces.
    """
    scaled = df.withColumn("_s", F.col(score) / F.lit(float(temperature)))
    if top_k > PER_TASK:
        first = top_rows(scaled, group, -F.col("_s"), token, top_k, "_at", **scale)
        least = cut_lineage(first.where(F.col("_at") == top_k).select(group, F.col("_s").alias("_least")))
        scaled = lookup_join(scaled, least, [group], [group, token], "left", **scale).where(
            F.col("_least").isNull() | (F.col("_s") >= F.col("_least"))).drop("_least")
    elif top_k > 0:
        by_score = Window.partitionBy(group).orderBy(F.desc("_s"))
        scaled = scaled.withColumn("_rank", F.rank().over(by_score)).where(F.col("_rank") <= top_k).drop("_rank")
    tops = cut_lineage(scaled.groupBy(group).agg(F.max("_s").alias("_top")))
    weighted = lookup_join(scaled, tops, [group], [group, token], **scale).withColumn(
        "_w", F.exp(F.col("_s") - F.col("_top"))).drop("_top")
    summed = running_total(weighted, [group], [F.desc("_s"), F.asc(token)], F.col("_w"), "_upto", "_all")
    if top_p > 0:
        summed = summed.where((F.col("_upto") - F.col("_w")) / F.col("_all") <= F.lit(top_p))
        if renormalise:
            # The kept candidates come first, so their mass is their largest running total.
            mass = cut_lineage(summed.groupBy(group).agg(F.max("_upto").alias("_kept")))
            summed = lookup_join(summed, mass, [group], [group, token], **scale).withColumn("_all", F.col("_kept"))
    return summed.select(*df.columns, (F.col("_w") / F.col("_all")).alias("prob"))


def seeded_uniform(key: Column, seed: int) -> Column:
    """Number in (0, 1) from a hash of the key, the same on every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**8))


def sample_candidate(kept: DataFrame, seed: int, group: str = "grp", token: str = "token",
                     prob: str = "prob") -> DataFrame:
    """One draw per group, in proportion to ``prob`` (which need not sum to 1).

    The largest of log p plus Gumbel noise is a multinomial draw, and a maximum is
    combined before the shuffle.
    """
    key = F.concat_ws("|", F.col(group).cast("string"), F.col(token).cast("string"))
    noise = -F.log(-F.log(seeded_uniform(key, seed)))
    return kept.where(F.col(prob) > 0).groupBy(group).agg(
        F.max_by(F.col(token), F.log(prob) + noise).alias(token))
