"""Projections, predicates, limits and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlab import values as v
from reviewlab.scale import lookup_join
from reviewlab.session import cut_lineage


def project(df: DataFrame, keep: Sequence[str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    return (df.select(*keep) if keep is not None else df).drop(*drop)


def with_lengths(df: DataFrame, cols: Mapping[str, str] | None = None) -> DataFrame:
    """Character counts; ``cols`` maps new column to text column."""
    cols = cols or {"customer_len": "review", "owner_len": "reply"}
    return df.withColumns({new: F.length(text) for new, text in cols.items()})


def fill_missing(df: DataFrame, defaults: Mapping[str, str] | None = None) -> DataFrame:
    """Placeholders for absent ratings and menus."""
    defaults = defaults or {"taste": v.NO_RATING, "quantity": v.NO_RATING,
                            "delivery": v.NO_RATING, "menu": v.NO_MENU}
    present = {c: d for c, d in defaults.items() if c in df.columns}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in present.items()})


def require_reply(df: DataFrame, reply: str = "reply") -> DataFrame:
    return df.where(F.col(reply).isNotNull())


def in_band(col: Column, limits: tuple[int, int], inclusive: bool = True) -> Column:
    size = F.length(col)
    low, high = limits
    return size.between(low, high) if inclusive else (size > low) & (size < high)


def length_band(df: DataFrame, limits: Mapping[str, tuple[int, int]] | None = None,
                inclusive: bool = True) -> DataFrame:
    """Keep rows whose texts are within character limits; missing texts drop out."""
    limits = limits or {"review": v.REVIEW_LIMITS, "reply": v.REPLY_LIMITS}
    for name, band in limits.items():
        df = df.where(in_band(F.col(name), band, inclusive))
    return df


def similarity_gate(df: DataFrame, gates: Mapping[str, float] | None = None) -> DataFrame:
    """Keep rows with every score above its gate (strictly)."""
    gates = gates or {"glove": v.SIMILARITY_GATE, "sbert": v.SIMILARITY_GATE}
    for name, gate in gates.items():
        df = df.where(F.col(name) > F.lit(gate))
    return df


def reply_ratio_filter(df: DataFrame, row_id: Sequence[str], store: str = "store",
                       reply: str = "reply", divisor: int = 10) -> DataFrame:
    """Drop stores where ``reviews // divisor`` exceeds the number of replies.

    The list of kept stores is written out once, then measured and joined.
    """
    counts = df.groupBy(store).agg(F.count("*").alias("_reviews"), F.count(reply).alias("_replies"))
    answered = counts.where(F.floor(F.col("_reviews") / divisor) <= F.col("_replies")).select(store)
    return lookup_join(df, cut_lineage(answered), [store], row_id, "left_semi")


def parse_count(col: Column, offset: int = 0) -> Column:
    """Integer behind ``offset`` characters of a labelled text; NULL where it is none."""
    rest = F.regexp_replace(F.substring(col, offset + 1, 2**31 - 1), f"^[{v.SPACE}]+|[{v.SPACE}]+$", "")
    return rest.try_cast("bigint")


def key_filter(df: DataFrame, col: str, value: object) -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


def head_rows(df: DataFrame, n: int, order: str = "review_id") -> DataFrame:
    return df.orderBy(order).limit(n)


def seeded_hash(row_id: Column, seed: int) -> Column:
    """32 hex digits, the same for the same row and seed on every engine with md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))


def sample_rows(df: DataFrame, n: int, seed: int, row_id: str = "review_id") -> DataFrame:
    """``n`` random rows, reproducible for a seed and independent of partitioning."""
    return df.orderBy(seeded_hash(F.col(row_id), seed), row_id).limit(n)


def sample_fraction(df: DataFrame, fraction: float, seed: int, row_id: str = "review_id") -> DataFrame:
    """About ``fraction`` of the rows in one pass, without a sort."""
    cut = F.lit(f"{min(int(fraction * 16**8), 16**8 - 1):08x}")
    keep = F.substring(seeded_hash(F.col(row_id), seed), 1, 8) < cut
    return df if fraction >= 1 else df.where(keep)
