"""Assembly of fixed-length training examples from arrays of token ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100


def _repeat(value: Column | int, times: Column) -> Column:
    item = value if isinstance(value, Column) else F.lit(value)
    return F.array_repeat(item, F.greatest(times, F.lit(0)))


def pad_or_cut(ids: Column, n: int, fill: int) -> Column:
    """Exactly ``n`` ids: padded on the right, or cut."""
    return F.slice(F.concat(ids, _repeat(fill, F.lit(n) - F.size(ids))), 1, n)


def attention_mask(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: (x != F.lit(pad)).cast("int"))


def restore_ignored(labels: Column, pad: int) -> Column:
    return F.transform(labels, lambda x: F.when(x == IGNORED, F.lit(pad)).otherwise(x))


def seq2seq_example(review: Column, reply: Column, n: int, eos: int, pad: int,
                    mode: str = "train") -> Column:
    """struct<input_ids, decoder_input_ids, labels> for an encoder-decoder model.

    Labels are the reply and an end id; the decoder input is the same, moved right behind
    an end id. Labels are padded with the ignored id for training, with ``pad`` for test.
    """
    if mode not in ("train", "test"):
        raise ValueError(f"unknown mode {mode!r}")
    labels = F.concat(reply, F.array(F.lit(eos)))
    decoder = F.concat(F.array(F.lit(eos)), reply)
    return F.struct(
        pad_or_cut(review, n, pad).alias("input_ids"),
        pad_or_cut(decoder, n, pad).alias("decoder_input_ids"),
        pad_or_cut(labels, n, IGNORED if mode == "train" else pad).alias("labels"),
    )


def causal_example(article: Column, reply: Column, n: int, mark: int, eos: int, pad: int,
                   labels: str = "reply") -> Column:
    """struct<input_ids, attention_mask, labels, too_long> for a decoder-only model.

    ``article`` starts with its begin id and prefix. If the example is longer than ``n``
    the end of the article is cut and the reply stays whole; a reply longer than ``n``
    leaves the row over-long, flagged by ``too_long``. The mask is 0 on the article, 1 on
    the reply, 0 on padding. Labels: ``reply`` holds the marked reply and padding;
    ``aligned`` holds ignored ids for the article, then the reply behind its mark.
    """
    summary = F.concat(F.array(F.lit(mark)), reply, F.array(F.lit(eos)))
    excess = F.greatest(F.size(article) + F.size(summary) - n, F.lit(0))
    room = F.greatest(F.size(article) - excess, F.lit(0))
    kept = F.slice(article, F.lit(1), room)
    rest = F.lit(n) - room - F.size(summary)
    if labels == "reply":
        target = F.concat(summary, _repeat(pad, F.lit(n) - F.size(summary)))
    elif labels == "aligned":
        after_mark = F.concat(reply, F.array(F.lit(eos)))
        target = F.concat(_repeat(IGNORED, room), after_mark, _repeat(IGNORED, rest + 1))
    else:
        raise ValueError(f"unknown labels {labels!r}")
    return F.struct(
        F.concat(kept, summary, _repeat(pad, rest)).alias("input_ids"),
        F.concat(_repeat(0, room), _repeat(1, F.size(summary)), _repeat(0, rest)).alias("attention_mask"),
        target.alias("labels"),
        (F.size(summary) > n).alias("too_long"),
    )


def rated_prefix(bos: int, taste: Column, quantity: Column, delivery: Column, review: Column,
                 headings: list[list[int]]) -> Column:
    """Begin id, then each rating and the review behind the ids of its heading."""
    parts = [F.array(F.lit(bos))]
    for heading, ids in zip(headings, (taste, quantity, delivery, review), strict=True):
        parts += [F.array(*[F.lit(i) for i in heading]), ids]
    return F.concat(*parts)


def prompt_prefix(bos: int, prompt: int, k: int, review: Column) -> Column:
    """Begin id, ``k`` copies of the prompt id, the review."""
    return F.concat(F.array(F.lit(bos)), _repeat(prompt, F.lit(k)), review)


def truncated_example(prompt: Column, reply: Column, in_max: int = 256, out_max: int = 128) -> Column:
    """struct<input_ids, attention_mask, labels> cut to two limits, unpadded."""
    ids = F.slice(prompt, 1, in_max)
    return F.struct(ids.alias("input_ids"), F.transform(ids, lambda x: F.lit(1)).alias("attention_mask"),
                    F.slice(reply, 1, out_max).alias("labels"))


def pair_example(review: Column, reply: Column, prefix: list[int], n: int = 512) -> Column:
    """struct<input_ids, labels>: review and prefixed reply as one sequence, cut to ``n``.

    The longer part is cut first, down to the length of the shorter one; if that is not
    enough, both keep half. Labels equal the inputs.
    """
    target = F.concat(F.array(*[F.lit(i) for i in prefix]), reply)
    a, b = F.size(review), F.size(target)
    short = F.least(a, b)
    long = F.greatest(short, F.lit(n) - short)
    both = short + long > n
    short_kept = F.when(both, F.lit(n // 2)).otherwise(short)
    long_kept = F.when(both, F.lit(n - n // 2)).otherwise(long)
    ids = F.concat(
        F.slice(review, F.lit(1), F.when(a > b, long_kept).otherwise(short_kept)),
        F.slice(target, F.lit(1), F.when(a > b, short_kept).otherwise(long_kept)),
    )
    return F.struct(ids.alias("input_ids"), ids.alias("labels"))


def lm_example(ids: Column, n: int, start: int, end: int, pad: int) -> Column:
    """struct<input_ids, attention_mask>: start, text, end; cut or padded to ``n``."""
    whole = F.concat(F.array(F.lit(start)), ids, F.array(F.lit(end)))
    used = F.least(F.size(whole), F.lit(n))
    return F.struct(
        pad_or_cut(whole, n, pad).alias("input_ids"),
        F.concat(_repeat(1, used), _repeat(0, F.lit(n) - used)).alias("attention_mask"),
    )
