"""Similarity scores of text pairs as columns of the pair table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlab.functions.overlap import tfidf_pair_cosine, vector_cosine
from reviewlab.functions.text import tokenise
from reviewlab.operators.token_sums import with_token_sums
from reviewlab.scale import compute_once


def with_tokens(df: DataFrame, texts: Mapping[str, str]) -> DataFrame:
    """Add token columns; ``texts`` maps new column to text column."""
    return df.withColumns({new: tokenise(F.col(text)) for new, text in texts.items()})


def with_tfidf(df: DataFrame, pairs: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Add two-text TF-IDF cosines; ``pairs`` maps new column to two token columns."""
    return compute_once(df, {new: tfidf_pair_cosine(a, b) for new, (a, b) in pairs.items()})


def with_word_vector_cosine(df: DataFrame, vectors: DataFrame, texts: Mapping[str, Column],
                            pairs: Mapping[str, tuple[str, str]], row_id: str = "review_id",
                            **scale: int) -> DataFrame:
    """Add cosines of mean word vectors; 0 where a side has no known token.

    ``texts`` maps a name to a token column, ``pairs`` new column to two of these names. Sums of vectors have the cosine
    of their means (``token_sums``).
    """
    names = {name: f"_sum{i}" for i, name in enumerate(texts)}
    summed = with_token_sums(df, vectors, {names[name]: tokens for name, tokens in texts.items()}, **scale)
    scores = {new: F.coalesce(vector_cosine(F.col(names[a]), F.col(names[b])), F.lit(0.0)) for new, (a, b) in pairs.items()}
    return compute_once(summed, scores).drop(*names.values())


def with_vector_cosine(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add cosines of sentence vectors held in columns of ``df``."""
    return compute_once(df, {new: vector_cosine(F.col(a), F.col(b)) for new, (a, b) in pairs.items()})


PREDICTION_SCORES = ["tfidf_review", "tfidf_reply", "glove_review", "glove_reply",
                     "sbert_review", "sbert_reply"]


def prediction_report(predictions: DataFrame, vectors: DataFrame, sentence_vectors: Sequence[str],
                      row_id: str = "review_id", **scale: int) -> DataFrame:
    """Six similarity columns of a prediction table.

    ``predictions`` holds review, reply and predicted_reply; ``sentence_vectors`` names
    the columns with the sentence vectors of the three. Word vectors go first, on tokens that
    are no column yet: what their lookup writes and moves is the texts alone.
    """
    texts = {"_review": "review", "_reply": "reply", "_pred": "predicted_reply"}
    df = with_word_vector_cosine(predictions, vectors, {name: tokenise(F.col(text)) for name, text in texts.items()},
                                 {"glove_review": ("_review", "_pred"), "glove_reply": ("_reply", "_pred")}, row_id, **scale)
    df = with_tokens(df, {f"_t{name}": text for name, text in texts.items()})
    df = with_tfidf(df, {"tfidf_review": (F.col("_t_review"), F.col("_t_pred")),
                         "tfidf_reply": (F.col("_t_reply"), F.col("_t_pred"))})
    v_review, v_reply, v_pred = sentence_vectors
    df = with_vector_cosine(df, {"sbert_review": (v_review, v_pred), "sbert_reply": (v_reply, v_pred)})
    return df.select(*predictions.columns, *PREDICTION_SCORES)
