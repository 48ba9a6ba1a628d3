"""Masking of organisations and places found by a gazetteer or a tagger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab import values as v
from reviewlab.functions.masking import mask_tagged
from reviewlab.functions.overlap import ngrams
from reviewlab.functions.text import regex_extract
from reviewlab.operators.gazetteer import mask_substrings
from reviewlab.scale import lookup_join


def find_entities(df: DataFrame, col: str, gazetteer: DataFrame, row_id: str = "review_id",
                  **scale: int) -> DataFrame:
    """One row per (row, term): gazetteer terms whose words stand in the text in a row.

    Works for a gazetteer of any size: runs of as many words as some term has are joined
    with the terms.
    """
    word = f"[{v.WORD}]+"
    terms = gazetteer.select(F.col("term").alias("word"), "type",
                             F.array_join(regex_extract(F.col("term"), word), " ").alias("key"),
                             F.size(regex_extract(F.col("term"), word)).alias("n")).where(F.col("n") > 0)
    # Lengths that occur among the terms, a handful of numbers.
    lengths = sorted(r.n for r in terms.select("n").distinct().collect())
    tokens = df.select(row_id, regex_extract(F.col(col), word).alias("_tokens"))
    runs = [ngrams(F.col("_tokens"), n) for n in lengths] or [F.array().cast("array<string>")]
    spans = tokens.select(row_id, F.explode(F.array_distinct(F.concat(*runs))).alias("key"))
    return lookup_join(spans, terms.drop("n"), ["key"], [row_id, "key"], **scale).select(row_id, "word", "type")


def _mask_found(df: DataFrame, col: str, found: DataFrame, row_id: str) -> DataFrame:
    entities = found.groupBy(row_id).agg(F.collect_list(F.struct("word", "type")).alias("_entities"))
    joined = df.join(entities, row_id, "left")
    return joined.withColumn(col, mask_tagged(F.col(col), F.col("_entities"))).drop("_entities")


def mask_entities(df: DataFrame, col: str, gazetteer: DataFrame, match: str = "substring",
                  row_id: str = "review_id", **scale: int) -> DataFrame:
    """Replace gazetteer terms in ``col``: organisations first, then places.

    ``substring`` replaces a term wherever it stands, also inside a word, which suits
    languages whose particles stick to nouns (see ``gazetteer``). ``token`` replaces the terms whose
    words stand in the text as words. Both take a gazetteer of any size.
    """
    if match == "token":
        return _mask_found(df, col, find_entities(df, col, gazetteer, row_id, **scale), row_id)
    if match != "substring":
        raise ValueError(f"unknown match {match!r}")
    return mask_substrings(df, col, gazetteer, row_id, **scale)
