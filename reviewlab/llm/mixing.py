"""Mixing sources to target weights by Poisson replication.

A document is repeated as often as a Poisson draw says, whose mean is the repetition rate of
its source: target rows of the source over its rows. The draw inverts the distribution at a
uniform number made of a hash of (seed, id), so a lost task draws the same again. Rows without
an id, or whose id stands on several rows, are told apart by a digest of all their columns and a
number among equal rows, so that each draws for itself. Copies are then dealt out and sorted by
another hash, which mixes the whole table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlab.scale import cut_lineage, lookup_join

#: A larger mean is drawn as a sum of equal parts, as a sum of Poisson numbers is one.
PART_MEAN = 16.0
#: 1 - CDF is below 1e-17 there for a mean of 16.
LAST = 64
#: Equal rows that one task numbers.
PIECE = 1 << 16


def _uniform(*parts: Column | str) -> Column:
    """52 bits of an MD5, as a number from 0 up to 1."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(p), F.lit("-"))
                                      for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """The first values of the distribution function, P(X <= 0), P(X <= 1), and so on."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(LAST)), start, step, lambda acc: acc["all"])


def source_rates(df: DataFrame, weights: Mapping[str | None, float] | None = None, temperature: float = 0.5,
                 total: int | None = None, source: str = "source") -> DataFrame:
    """(_source, weight, rate) per source of ``df``.

    Weights are shares of the result, scaled to sum to 1; a source that is not named gets
    none. Without weights, a source weighs its rows to the power of ``temperature``. The
    result has ``total`` rows on average, as many as ``df`` if not given.
    """
    counts = cut_lineage(df.groupBy(source_key(source).alias("_source")).agg(F.count("*").alias("_rows")))
    if weights is None:
        weigh = F.pow(F.col("_rows").cast("double"), F.lit(temperature))
    else:
        weigh = F.lit(0.0)
        for name, value in weights.items():
            weigh = F.when(F.col("_source") == ("-" if name is None else f"={name}"), F.lit(float(value))).otherwise(weigh)
    weighed = counts.withColumn("_w", F.round(weigh, 9))
    sums = weighed.agg(F.sum("_rows").alias("rows"), F.sum(F.col("_w").cast("decimal(38,9)")).cast("double").alias("w")).first()
    whole, goal = sums.w or 1.0, float(total if total is not None else sums.rows or 0)
    return weighed.select("_source", F.round(F.col("_w") / F.lit(whole), 9).alias("weight"),
                          F.round(F.col("_w") / F.lit(whole) * F.lit(goal) / F.col("_rows"), 9).alias("rate"))


def source_key(source: str = "source") -> Column:
    """A missing source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("-"))


def drawn_rows(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` with ``_who``, different in all rows: the id, or beyond it a digest of the row and a number among equal rows.

    Equal rows are counted and numbered as they are written out again, in pieces, so no group is one task.
    """
    who = F.col(id_col).cast("string")
    shared = cut_lineage(df.groupBy(id_col).agg(F.count("*").alias("_n")).where(F.col(id_col).isNull() | (F.col("_n") > 1)))
    plain = df.where(F.col(id_col).isNotNull())
    if shared.isEmpty():
        return plain.withColumn("_who", who)
    ids = shared.where(F.col(id_col).isNotNull()).select(id_col)
    spread = [c for c, kind in df.dtypes if "map<" not in kind]
    alone = lookup_join(plain, ids, [id_col], spread, "left_anti").withColumn("_who", who)
    again = lookup_join(plain, ids, [id_col], spread, "left_semi").unionByName(df.where(F.col(id_col).isNull()))
    digests = [F.md5(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))) for c in df.columns]
    kinds = again.withColumn("_digest", F.md5(F.concat(*digests))).groupBy("_digest").agg(
        F.count("*").alias("_n"), *[F.first(c).alias(c) for c in df.columns])
    pieces = kinds.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(PIECE).cast("long")))).repartition("_digest", "_from")
    numbered = pieces.withColumn("_no", F.explode(F.sequence("_from", F.least("_n", F.col("_from") + PIECE) - 1)))
    return alone.unionByName(numbered.select(*df.columns, F.concat_ws("|", F.coalesce(who, F.lit("-")), "_digest", F.col("_no").cast("string")).alias("_who")))


def mix_sources(df: DataFrame, weights: Mapping[str | None, float] | None = None, temperature: float = 0.5,
                total: int | None = None, seed: int = 42, id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """Rows of ``df`` repeated by their Poisson counts and mixed, with copy_no, n_copies, rate, order_key.

    Columns of ``df`` with one of these names are replaced. A missing source is a source of its
    own; every row draws for itself, also those that share an id or have none. Copies of a row are
    numbered from 0; rows that draw 0 leave. An empty table gives no rows.
    """
    made = ["copy_no", "n_copies", "rate", "weight", "order_key"]
    names = [c for c in df.columns if c not in made]
    inner = {c: f"_k{i}" for i, c in enumerate(names)}
    rates = source_rates(df, weights, temperature, total, source)
    parts = F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("int")
    rates = rates.where(F.col("rate") > 0).withColumn("_parts", parts)
    table = cut_lineage(rates.withColumn("_cdf", poisson_cdf(F.col("rate") / F.col("_parts"))))
    keyed = drawn_rows(df.drop(*made).toDF(*inner.values()), inner[id_col]).withColumn("_source", source_key(inner[source]))
    known = lookup_join(keyed, table, ["_source"], ["_who"])
    draw = F.aggregate(
        F.sequence(F.lit(0), F.col("_parts") - 1), F.lit(0),
        lambda n, j: n + F.size(F.filter("_cdf", lambda c: c <= _uniform(str(seed), F.col("_who"), j))))
    counted = known.withColumn("n_copies", draw.cast("int")).where(F.col("n_copies") > 0).drop("_cdf", "_parts", "_source")
    copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"order {seed}"), F.col("_who"),
                                               F.col("copy_no").cast("string"))), 1, 15), 16, 10).cast("long")
    ordered = copies.withColumn("order_key", key).drop("_who").withColumnsRenamed({k: c for c, k in inner.items()})
    return ordered.repartition("order_key").sortWithinPartitions("order_key")
