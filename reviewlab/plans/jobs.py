"""End-to-end jobs: preprocessing, scoring, selection, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlab import values as v
from reviewlab.functions.labels import common_labels, label_jaccard, threshold_labels
from reviewlab.functions.masking import (
    mask_customer, mask_handles, mask_phones, mask_store, mask_tagged, mask_terms, mask_urls_emails,
)
from reviewlab.functions.text import collapse_space, remove_literal, tokenise
from reviewlab.operators.examples import split_train_test_val
from reviewlab.operators.filters import length_band, similarity_gate
from reviewlab.operators.masking import mask_entities
from reviewlab.operators.models import Model, score_labels, score_labels_batch, tag_entities
from reviewlab.operators.rouge import rouge_lcs, sentence_list
from reviewlab.operators.similarity import (
    PREDICTION_SCORES, prediction_report, with_tfidf, with_tokens, with_vector_cosine, with_word_vector_cosine,
)
from reviewlab.operators.stats import grand_mean, mean_scores
from reviewlab.scale import compute_once
from reviewlab.sources.tables import write_columnar


def clean_and_mask(df: DataFrame, compat: bool = False) -> DataFrame:
    """Collapse white space, then mask the row's customer and store in the reply."""
    spaced = {c: collapse_space(F.col(c), compat) for c in ("menu", "review", "reply") if c in df.columns}
    customer = mask_customer(spaced["reply"], F.col("customer_id"))
    return compute_once(df, {**spaced, "reply": mask_store(customer, F.col("store"))})


def preprocess_reviews(df: DataFrame, gazetteer: DataFrame | None = None, match: str = "substring",
                       tagger: Callable[[], Model] | None = None, compat: bool = False) -> DataFrame:
    """First masking pass: white space, customer, store, then organisations and places."""
    out = clean_and_mask(df, compat)
    if gazetteer is not None:
        out = mask_entities(out, "reply", gazetteer, match)
    if tagger is not None:
        tagged = tag_entities(out, "reply", tagger, "_entities")
        out = tagged.withColumn("reply", mask_tagged(F.col("reply"), F.col("_entities"))).drop("_entities")
    return out


def additional_masking(reply: Column, stores: Sequence[str] = v.STORE_TERMS,
                       places: Sequence[str] = v.PLACE_TERMS,
                       organisations: Sequence[str] = v.ORGANISATION_TERMS,
                       customers: Sequence[str] = v.CUSTOMER_TERMS) -> Column:
    """Second masking pass. Handles go before addresses, so a mail address loses its tail first."""
    out = mask_terms(reply, stores, v.STORE)
    out = mask_terms(out, places, v.PLACE)
    out = mask_terms(out, organisations, v.ORGANISATION)
    out = mask_urls_emails(mask_phones(mask_handles(out)))
    return remove_literal(mask_terms(out, customers, v.CUSTOMER))


def score_pairs(df: DataFrame, vectors: DataFrame, sentence_vectors: tuple[str, str],
                lexicon: DataFrame | None = None, bias: float = 0.0,
                scorer: Callable[[], Model] | None = None, **scale: int) -> DataFrame:
    """Add tfidf, glove and sbert scores of (review, reply), and label sets if a scorer is given.

    Filter by length first: the scores are the costly part.
    """
    # Scores that a large table may move rows for go first.
    pairs = with_word_vector_cosine(df, vectors, {"_va": tokenise(F.col("review")), "_vb": tokenise(F.col("reply"))},
                                    {"glove": ("_va", "_vb")}, **scale)
    emotions = {"review_emotions": "review", "reply_emotions": "reply"}
    if lexicon is not None:
        pairs = with_emotions(pairs, emotions, lexicon, bias, **scale)
    pairs = with_tokens(pairs, {"_a": "review", "_b": "reply"})
    pairs = with_tfidf(pairs, {"tfidf": (F.col("_a"), F.col("_b"))})
    pairs = with_vector_cosine(pairs, {"sbert": sentence_vectors}).drop("_a", "_b")
    if lexicon is None:
        pairs = with_emotions(pairs, emotions, scorer=scorer)
    return pairs


def with_emotions(df: DataFrame, cols: Mapping[str, str], lexicon: DataFrame | None = None, bias: float = 0.0,
                  scorer: Callable[[], Model] | None = None, **scale: int) -> DataFrame:
    """Add label sets for text columns, and the common set of the first two."""
    if lexicon is not None:
        df = score_labels(df, dict(cols), lexicon, bias, **scale)
    elif scorer is not None:
        for new, text in cols.items():
            df = score_labels_batch(df, text, scorer, new)
    else:
        return df
    return common_emotions(df, cols)


def common_emotions(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """Label sets from label scores, and the common set of the first two."""
    df = df.withColumns({new: threshold_labels(F.col(new)) for new in cols})
    first, second = list(cols)[:2]
    return df.withColumn("common_emotions", common_labels(F.col(first), F.col(second)))


def select_training_set(scored: DataFrame, limits: Mapping[str, tuple[int, int]] | None = None,
                        gates: Mapping[str, float] | None = None, seed: int = 42, exact: bool = False,
                        path: str | None = None) -> DataFrame:
    """Length band, similarity gate, split; written by split if a path is given."""
    kept = similarity_gate(length_band(scored, limits, inclusive=False), gates)
    split = split_train_test_val(kept, seed=seed, exact=exact)
    if path:
        write_columnar(split, path)
    return split


def emotion_report(predictions: DataFrame, lexicon: DataFrame | None = None, bias: float = 0.0,
                   scorer: Callable[[], Model] | None = None, **scale: int) -> DataFrame:
    """Add label sets of the three texts and the overlap of the review with either reply."""
    cols = {"review_emotions": "review", "reply_emotions": "reply", "predicted_emotions": "predicted_reply"}
    df = with_emotions(predictions, cols, lexicon, bias, scorer, **scale)
    return df.withColumns({
        "reply_emotion_sim": label_jaccard(F.col("review_emotions"), F.col("reply_emotions")),
        "predicted_emotion_sim": label_jaccard(F.col("review_emotions"), F.col("predicted_emotions")),
    })


def mean_emotion_sim(report: DataFrame) -> DataFrame:
    """Mean label overlap for replies and for predictions."""
    return mean_scores(report, ["reply_emotion_sim", "predicted_emotion_sim"])


def evaluate_predictions(predictions: DataFrame, vectors: DataFrame, sentence_vectors: Sequence[str],
                         weight: float = 1.0, **scale: int) -> DataFrame:
    """One row: means of the six similarities, their mean, mean ROUGE-L and ROUGE-W.

    With weight 1 ROUGE-W is ROUGE-L and is not computed again.
    """
    scored = prediction_report(predictions, vectors, sentence_vectors, **scale)
    lines = scored.withColumns({"hyp_lines": sentence_list(F.col("predicted_reply")),
                                "ref_lines": sentence_list(F.col("reply"))})
    rouge = rouge_lcs(lines, "rouge_l")
    rouge = rouge.withColumn("rouge_w", F.col("rouge_l")) if weight == 1.0 else rouge_lcs(rouge, "rouge_w", weight=weight)
    parts = {f"{m}_{x}": F.col(f"{m}.{x}") for m in ("rouge_l", "rouge_w") for x in ("p", "r", "f")}
    flat = rouge.select(*PREDICTION_SCORES, *[c.alias(name) for name, c in parts.items()])
    return grand_mean(mean_scores(flat, [*PREDICTION_SCORES, *parts]), PREDICTION_SCORES)
