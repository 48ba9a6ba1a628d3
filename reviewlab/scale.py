"""Patterns shared by the operators where one key, or the whole table, is one group.

* ``running_total`` / ``dense_index`` / ``top_rows`` / ``exact_quantiles`` order the whole table (or
  arbitrarily large groups) without a single-task window: rows are range partitioned,
  so a group is split into pieces no larger than a partition, and only one total per
  (group, piece) goes through a second, small window.
* ``next_in_group`` does the same for "next row" lookups over integer positions, with
  blocks of positions instead of sampled ranges, hence without a checkpoint.
* ``lookup_join`` broadcasts a lookup table after measuring it; beyond the limit it shuffles
  and salts the hot keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlab.session import cut_lineage

PIECE = "_piece"
BROADCAST_BYTES = 64 * 1024 * 1024


# ---------------------------------------------------------------- lookup joins

def _width(field: T.StructField) -> Column:
    col = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return F.coalesce(F.size(col), F.lit(0)) * 8 + 16
    if isinstance(kind, T.AtomicType):
        return F.lit(8)
    return F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0)) + 16


def table_bytes(df: DataFrame) -> int:
    """Size of the rows of ``df``, measured by one aggregation over it."""
    row = reduce(lambda a, b: a + b, [_width(f) for f in df.schema.fields])
    return df.agg(F.sum(row.cast("long")).alias("b")).first()["b"] or 0


def lookup_join(df: DataFrame, table: DataFrame, on: Sequence[str], row_id: Sequence[str],
                how: str = "inner", limit: int = BROADCAST_BYTES, tasks: int | None = None) -> DataFrame:
    """Equi-join ``df`` with a lookup ``table`` whose key may be hot in ``df``.

    ``table`` is read twice, to measure and to join it, so a costly one is written first.
    A table measured below ``limit`` is broadcast. Beyond that both sides are shuffled to
    ``tasks`` (the number of shuffle partitions, unless given), and a key that holds more than
    a task's share of the rows of ``df`` is joined on (key, salt): it gets as many salts as it
    holds shares, its rows are spread over them by ``row_id``, a unique key of ``df``, and its
    match is repeated once per salt. There are fewer such keys than tasks, so they are safe to
    broadcast; they are found in one more pass over ``df``. Every match is kept. Rows without a key match nothing and
    are spread as well.
    """
    on = list(on)
    if table_bytes(table) <= limit:
        return df.join(F.broadcast(table), on, how)
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = hot_keys(df, on, tasks)
    if not salts:
        return df.join(table, on, how)
    rows = [(h, n) for h, n in salts.items()]
    hot = F.broadcast(df.sparkSession.createDataFrame(rows, "_hash long, _salts int"))
    keyless = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    spread_over = F.when(keyless, F.lit(tasks)).otherwise(F.coalesce("_salts", F.lit(1)))
    salted = df.withColumn("_hash", F.xxhash64(*on)).join(hot, "_hash", "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*row_id), spread_over).cast("int")).drop("_salts", "_hash")
    every = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    # Hashes depend on the type, so both sides have that of df; what does not fit into it matches nothing.
    typed = [F.col(c).try_cast(df.schema[c].dataType) for c in on]
    copies = table.withColumn("_hash", F.xxhash64(*typed)).join(hot, "_hash", "left").withColumn("_salt", F.explode(every)).drop("_salts", "_hash")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def hot_keys(df: DataFrame, on: Sequence[str], tasks: int) -> dict[int, int]:
    """Hashes of keys that hold more than the share of one of ``tasks``, with how many shares; one of no key, if there are any.

    One pass: a sketch of frequent items, of fixed size, and a count. Which keys get salts decides how evenly rows are
    spread, not what is joined, so the sketch need not be exact.
    """
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    items = df.select(F.when(known, F.xxhash64(*on)).alias("_h"))
    seen = items.agg(F.expr(f"approx_top_k(_h, {tasks + 1}, {max(10_000, 8 * tasks)})").alias("top"), F.count("*").alias("n")).first()
    return {x["item"]: -(-x["count"] * tasks // seen.n) for x in seen.top if x["count"] * tasks > seen.n}


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that treats NULL keys as equal, keeping the key columns of ``left``."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in on])
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in on])


# ------------------------------------------------------------ order over pieces

def ordered_pieces(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Range partition by (group, order) and tag each row with its partition.

    ``order`` has to be unique within a group, else ties cannot be split. Range bounds are
    sampled, so the tagged rows are written out before anything is derived from the tag.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *[F.col(c) for c in group], *order)
    return cut_lineage(placed.withColumn(PIECE, F.spark_partition_id()))


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column,
                  out: str, total: str | None = None) -> DataFrame:
    """Inclusive running total of ``value`` per group, for groups of any size.

    Rows move twice: to their range, and by (group, piece), which serves both the join
    with the offsets and the window. The window without a partition key, used when
    ``group`` is empty, runs over one row per partition only.
    """
    rows = ordered_pieces(df.withColumn("_value", value), group, order)
    part = [*group, PIECE]
    sums = rows.groupBy(*part).agg(F.sum("_value").alias("_sum"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *part,
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_sum").over(whole).alias("_total"),
    )
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = null_safe_join(rows, offsets, part)
    result = joined.withColumn(out, F.col("_before") + F.sum("_value").over(inside))
    if total:
        result = result.withColumn(total, F.col("_total"))
    return result.drop("_value", "_before", "_total", PIECE)


def dense_index(df: DataFrame, order: Sequence[Column], out: str, total: str | None = None) -> DataFrame:
    """0-based position of each row in the total order given by a unique ``order``.

    Rows move once, to their range, where they are sorted and numbered as they are written out. A
    position is that number plus the rows of all ranges before, which are added up over one row per range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The id holds the partition above 33 bits and the row's number in it below.
    numbered = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = cut_lineage(numbered).withColumn(PIECE, F.shiftright("_id", 33)).withColumn("_id", F.col("_id").bitwiseAND(F.lit(2**33 - 1)))
    whole = Window.orderBy(PIECE)
    counts = rows.groupBy(PIECE).agg(F.count("*").alias("_n"))
    offsets = counts.select(PIECE, F.coalesce(F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
                            F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    # As many rows as there are ranges.
    placed = rows.join(F.broadcast(offsets), PIECE).withColumn(out, F.col("_before") + F.col("_id"))
    return placed.select(*df.columns, out, *([F.col("_total").alias(total)] if total else []))


BINS = 1024


def top_rows(df: DataFrame, group: str, score: Column, tie: str, k: int, out: str, **scale: int) -> DataFrame:
    """The ``k`` rows of lowest ``score`` of each group, then of lowest ``tie``, with their position from 1.

    For any k and groups of any size. A histogram of each group says in which of its bins the k-th row lies;
    rows of later bins go. What is left is at most k rows and one bin per group, is range partitioned and numbered,
    a group in pieces, and cut exactly. ``score`` is a number, missing ones last; (score, tie) is unique.
    """
    rows = df.withColumn("_o", score.cast("double"))
    ends = cut_lineage(rows.groupBy(group).agg(F.min("_o").alias("_low"), F.max("_o").alias("_high")))
    width = F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    inside = F.coalesce(F.floor((F.col("_o") - F.col("_low")) / width * BINS), F.lit(0))
    binned = lookup_join(rows, ends, [group], [group, tie], "left", **scale).withColumn(
        "_bin", F.when(F.col("_o").isNull(), BINS).otherwise(F.least(inside, F.lit(BINS - 1)))).drop("_low", "_high")
    counts = binned.groupBy(group, "_bin").agg(F.count("*").alias("_n"))
    # At most BINS + 1 rows per group.
    upto = F.sum("_n").over(Window.partitionBy(group).orderBy("_bin"))
    last = counts.withColumn("_upto", upto).groupBy(group).agg(F.min(F.when(F.col("_upto") >= k, F.col("_bin"))).alias("_last"))
    cuts = cut_lineage(last.where("_last IS NOT NULL"))
    near = lookup_join(binned, cuts, [group], [group, tie], "left", **scale)
    near = near.where(F.col("_last").isNull() | (F.col("_bin") <= F.col("_last"))).drop("_last", "_bin")
    placed = running_total(near, [group], [F.col("_o").asc_nulls_last(), F.col(tie).asc()], F.lit(1).cast("long"), out)
    return placed.where(F.col(out) <= k).drop("_o")


ACCURACY = 10_000


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """One row of exact quantiles with linear interpolation; NULLs are left out.

    The column is scanned three times, so scores that are costly to compute are stored first.
    An approximate quantile sketch brackets each quantile within a few thousandths of the
    rows, a count proves the brackets right, and only rows inside a bracket are counted by
    value and ordered. A bracket the count does not confirm is opened to all rows.
    """
    x = df.select(F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    around = [min(max(p + side / ACCURACY, 0.0), 1.0) for p in probs for side in (-4, 4)]
    seen = x.agg(F.count("*").alias("n"), F.percentile_approx("_v", around, ACCURACY).alias("e")).first()
    if not seen.n:
        return x.agg(*[F.max("_v").alias(name) for name in names])
    places = [p * (seen.n - 1) for p in probs]
    bounds = [(seen.e[2 * i], seen.e[2 * i + 1]) for i in range(len(probs))]
    counts = x.agg(*[F.count_if(F.col("_v") < lo).alias(f"below{i}") for i, (lo, _) in enumerate(bounds)],
                   *[F.count_if(F.col("_v") <= hi).alias(f"upto{i}") for i, (_, hi) in enumerate(bounds)]).first()
    inside, below = [], []
    for i, (lo, hi) in enumerate(bounds):
        sure = counts[f"below{i}"] <= math.floor(places[i]) and counts[f"upto{i}"] > math.ceil(places[i])
        inside.append(F.col("_v").between(lo, hi) if sure else F.lit(True))
        below.append(counts[f"below{i}"] if sure else 0)
    which = F.filter(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(inside)]), lambda i: i.isNotNull())
    values = x.where(reduce(lambda a, b: a | b, inside)).groupBy("_v").agg(F.count("*").alias("_n"))
    cumulated = running_total(values.withColumn("_q", F.explode(which)), ["_q"], [F.col("_v")], F.col("_n"), "_upto")

    def value_at(i: int, rank: int) -> Column:
        return F.min(F.when((F.col("_q") == i) & (F.col("_upto") > rank - below[i]), F.col("_v")))

    exprs = []
    for i, name in enumerate(names):
        low, high = value_at(i, math.floor(places[i])), value_at(i, math.ceil(places[i]))
        exprs.append((low + (high - low) * F.lit(places[i] - math.floor(places[i]))).alias(name))
    return cumulated.agg(*exprs)


def compute_once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """``withColumns`` for costly expressions that later filters and columns use.

    A filter on a plain computed column is moved below it and computes it a second time.
    A generator of exactly one row keeps the value and adds no shuffle.
    """
    rest = [c for c in df.columns if c not in cols]
    made = F.inline(F.array(F.struct(*[c.alias(name) for name, c in cols.items()])))
    return df.select(*rest, made)


def spread(df: DataFrame) -> DataFrame:
    """Share out rows for costly work per row, if they come from fewer files than there are cores.

    A table of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


# ------------------------------------------------------------------- next row

def next_in_group(df: DataFrame, group: str, position: str, cols: Sequence[str],
                  block: int = 4096, keep_last: bool = True) -> DataFrame:
    """Add ``next_<col>`` from the row with the next higher ``position`` of the group.

    ``position`` is an integer, unique within the group. The last row of a group has no
    next one; ``keep_last`` says whether it stays in the result.

    Rows are windowed per (group, block of positions), so a task never sorts more than
    ``block`` rows of a group. If the smallest and largest position of the table show that
    no group leaves its first block, that is all. Otherwise rows of the groups that do are
    taken a second time, reduced to the edges of their blocks, and the last row of a block
    finds the first row of the next one there.
    """
    names = [f"next_{c}" for c in cols]

    def look_ahead(rows: DataFrame, *keys: str, suffix: str = "") -> DataFrame:
        ahead = Window.partitionBy(*keys).orderBy(position)
        leads = {f"next_{c}{suffix}": F.lead(c).over(ahead) for c in cols}
        return rows.withColumns({**leads, f"_found{suffix}": F.lead(position).over(ahead).isNotNull(),
                                 f"_rank{suffix}": F.row_number().over(ahead)})

    tagged = df.withColumn("_block", F.floor(F.col(position) / F.lit(block)))
    seen = look_ahead(tagged, group, "_block")
    out = [*df.columns, *names]
    span = df.agg(F.min(position).alias("low"), F.max(position).alias("high")).first()
    if span.low is None or (span.low >= 0 and span.high < block):
        return (seen if keep_last else seen.where("_found")).select(*out)

    beyond = (F.col(position) >= block) | (F.col(position) < 0)
    long_groups = cut_lineage(df.where(beyond).select(group).distinct())
    long_rows = look_ahead(lookup_join(tagged, long_groups, [group], [group, position], "left_semi"), group, "_block")
    edges = look_ahead(long_rows.where(~F.col("_found") | (F.col("_rank") == 1)), group, suffix="_edge")
    over_edge = edges.where(~F.col("_found")).select(
        *df.columns, *[F.col(f"{n}_edge").alias(n) for n in names], "_found_edge")
    every = seen.where("_found").select(*out)
    if keep_last:
        short = seen.where(~F.col("_found")).join(long_groups, group, "left_anti")
        return every.unionByName(short.select(*out)).unionByName(over_edge.select(*out))
    return every.unionByName(over_edge.where("_found_edge").select(*out))
