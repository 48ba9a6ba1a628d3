"""Scorers, encoders, taggers and generators, as joins or as functions over batches.

A model is a callable that takes a list of texts and returns one result per text. It
comes from a factory, called once per task, so a model is loaded once and not shipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from reviewlab import values as v
from reviewlab.functions.text import strip_and_flatten, tokenise
from reviewlab.operators.token_sums import with_token_sums
from reviewlab.scale import lookup_join
from reviewlab.session import cut_lineage

Model = Callable[[list[str]], Sequence]
SCORES = "array<struct<label string, score double>>"
ENTITIES = "array<struct<word string, type string>>"


def score_labels(df: DataFrame, cols: dict[str, str], lexicon: DataFrame, bias: float = 0.0,
                 row_id: str = "review_id", **scale: int) -> DataFrame:
    """Add scores of all labels for text columns, from weights of their tokens.

    ``cols`` maps new column to text column. score = 1 / (1 + exp(-(bias + sum of
    weights))). ``lexicon`` holds label, token and weight; every token occurrence counts.
    Labels are few: a token's weights are one vector with a place per label, and are summed up like word
    vectors, in one pass over the texts.
    """
    labels = [r.label for r in lexicon.select("label").distinct().orderBy("label").collect()]
    weights = lexicon.groupBy(F.col("token").alias("word")).agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col("label") == label, F.col("weight"))), F.lit(0.0)) for label in labels]).cast("array<double>").alias("vec"))
    sums = {f"_z_{new}": tokenise(F.col(text)) for new, text in cols.items()}
    summed = with_token_sums(df, weights, sums, **scale)

    def scores(new: str) -> Column:
        z = F.coalesce(F.col(f"_z_{new}"), F.array_repeat(F.lit(0.0), len(labels)))
        names = F.array(*map(F.lit, labels)) if labels else F.array().cast("array<string>")
        return F.zip_with(names, z, lambda label, x: F.struct(
            label.alias("label"), (1 / (1 + F.exp(-(F.lit(float(bias)) + x)))).alias("score")))

    return summed.withColumns({new: scores(new) for new in cols}).drop(*sums)


def _run(model: Model, texts: list[str]) -> list[tuple[object, str | None]]:
    """(result, error) per text. A batch that raises, or gives another number of results, is repeated text by text."""
    try:
        out = list(model(texts))
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} results for {len(texts)} texts")
        return [(x, None) for x in out]
    except Exception as e:
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        return [_run(model, [t])[0] for t in texts]


def outcome_function(factory: Callable[[], Model], returns: str, batch: int = 256) -> Callable[[Column], Column]:
    """Column function around a model: struct<result, error>.

    One bad text does not spoil others: it has no result but the error, its type and message. Missing texts are not shown to the
    model and have neither.
    """
    @F.pandas_udf(f"struct<result: {returns}, error: string>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        for texts in batches:
            # Results are handed on per batch of the model: those of all texts that Arrow brings at once may be large.
            for at in range(0, len(texts), batch):
                part = texts.iloc[at:at + batch].reset_index(drop=True)
                result, error = (pd.Series([None] * len(part), dtype=object) for _ in range(2))
                known = part.dropna()
                if len(known):
                    for i, (x, e) in zip(known.index, _run(model, known.tolist()), strict=True):
                        result.iat[i], error.iat[i] = x, e
                yield pd.DataFrame({"result": result, "error": error})

    # So that using the column in a filter and in the result runs the model once.
    return apply.asNondeterministic()


def with_outcome(df: DataFrame, factory: Callable[[], Model], text: Column, returns: str, out: str, failed: object = None,
                 error: str | None = None, counts: Observation | None = None) -> DataFrame:
    """Add the result of a model for a text as ``out``; ``failed`` stands for a failed or missing text.

    ``error``, if named, is a column with the error of a failed text. ``counts``, if given, holds the number of ``rows``, of
    ``missing`` texts, and of ``rejects`` once an action ran: a model that fails on every text gives a count, not just a
    table of NULLs.
    """
    df = df.withColumn("_outcome", outcome_function(factory, returns)(text)).withColumn("_missing", text.isNull())
    if counts is not None:
        df = df.observe(counts, F.count("*").alias("rows"), F.count_if("_missing").alias("missing"),
                        F.count("_outcome.error").alias("rejects"))
    lost = F.col("_outcome.error").isNotNull() | F.col("_missing")
    made = {out: F.when(lost, F.lit(failed)).otherwise(F.col("_outcome.result"))}
    if error:
        made[error] = F.col("_outcome.error")
    return df.withColumns(made).drop("_outcome", "_missing")


def score_labels_batch(df: DataFrame, col: str, scorer: Callable[[], Model], out: str, error: str | None = None,
                       counts: Observation | None = None) -> DataFrame:
    """Add label scores from a model that returns a list of (label, score) per text; for errors see ``with_outcome``."""
    return with_outcome(df, scorer, F.col(col), SCORES, out, error=error, counts=counts)


def encode_texts(df: DataFrame, cols: dict[str, str], encoder: Callable[[], Model], returns: str = "array<float>",
                 row_id: str = "review_id", errors: Mapping[str, str] | None = None, counts: Observation | None = None,
                 **scale: int) -> DataFrame:
    """Add encodings (vectors or tokens) of text columns; equal texts are encoded once.

    ``cols`` maps new column to text column, ``errors`` some of the new columns to columns for the error of a text the
    encoder fails on. Copies of a text are reduced to one before the model runs, its results are written out, and rows look
    theirs up by a digest. ``counts`` counts different texts, not rows, and is filled when this returns.
    """
    digests = {new: F.sha2(F.col(text), 256) for new, text in cols.items()}
    sides = F.array(*[F.struct(digests[new].alias("digest"), F.col(text).alias("text")) for new, text in cols.items()])
    wanted = df.select(F.inline(sides)).where(F.col("text").isNotNull())
    once = wanted.groupBy("digest").agg(F.any_value("text").alias("text"))
    codes = cut_lineage(with_outcome(once, encoder, F.col("text"), returns, "code", error="error", counts=counts).drop("text"))
    out = df
    for new in cols:
        own = codes.select(F.col("digest").alias("_digest"), F.col("code").alias(new), *[F.col("error").alias(e) for e in [(errors or {}).get(new)] if e])
        out = lookup_join(out.withColumn("_digest", digests[new]), own, ["_digest"], [row_id], "left", **scale).drop("_digest")
    return out


def tag_entities(df: DataFrame, col: str, tagger: Callable[[], Model], out: str = "entities") -> DataFrame:
    """Add (word, type) entities of a text; NULL where the tagger fails, which masks nothing."""
    return with_outcome(df, tagger, F.col(col), ENTITIES, out)


def generate_replies(df: DataFrame, prompt: str, generator: Callable[[], Model],
                     out: str = "predicted_reply") -> DataFrame:
    """Add a generated reply per prompt; a failing row gets a fixed text."""
    return with_outcome(df, generator, strip_and_flatten(F.col(prompt)), "string", out, failed=v.FAILED_REPLY)


def batched_map(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Function over batches of rows that adds or replaces columns."""
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(over, schema)
