"""Cleaning, templating, truncation and tokenising of text columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlab import values as v


def strip(col: Column) -> Column:
    """Trim every kind of white space on both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(col, f"^[{v.SPACE}]+|[{v.SPACE}]+$", "")


def words(col: Column) -> Column:
    """Split on runs of white space, without empty words."""
    return F.filter(F.split(col, f"[{v.SPACE}]+"), lambda w: w != "")


def collapse_space(col: Column, compat: bool = False) -> Column:
    """Runs of two or more white-space characters become one line break.

    ``compat`` uses the class that also holds the backslash and the letter n, for users
    who need the exact output of such data.
    """
    cls = v.SPACE + (r"\\n" if compat else "")
    return F.regexp_replace(col, f"[{cls}]{{2,}}", "\n")


def remove_literal(col: Column, literal: str = v.DROPPED_LITERAL) -> Column:
    return F.replace(col, F.lit(literal), F.lit(""))


def strip_and_flatten(col: Column) -> Column:
    """Trim, then delete line breaks."""
    return F.replace(strip(col), F.lit("\n"), F.lit(""))


def clean_decoded(col: Column, style: str = "marked") -> Column:
    """Reply part of decoded model text.

    ``marked``: text after the last reply mark and before the first end mark, trimmed.
    ``plain``: delete sentence-end and unknown tokens, trim.
    """
    if style == "marked":
        after = strip(F.element_at(F.split(col, re.escape(v.REPLY_MARK)), -1))
        return strip(F.element_at(F.split(after, re.escape(v.END_MARK)), 1))
    if style == "plain":
        without = F.replace(F.replace(col, F.lit("</s>"), F.lit("")), F.lit("<unk>"), F.lit(""))
        return strip(without)
    raise ValueError(f"unknown style {style!r}")


# Prompt layouts, {0} taste {1} quantity {2} delivery {3} review.
PROMPT_LAYOUTS = {
    "tight": "맛:{0} 양:{1} 배달:{2} 리뷰:{3}",
    "spaced": "맛: {0} 양: {1} 배달:{2} 리뷰:{3}",
    "short": "리뷰: {3}",
    "constant": "맛:5 양:5 배달:5 리뷰:{3}",
}


def build_prompt(taste: Column, quantity: Column, delivery: Column, review: Column,
                 style: str = "tight") -> Column:
    """Prompt text of a review; NULL if one of the columns it uses is NULL."""
    cols = [taste, quantity, delivery, review]
    parts = re.split(r"\{(\d)\}", PROMPT_LAYOUTS[style])
    pieces = [cols[int(p)] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p]
    return F.concat(*pieces)


def regex_extract(col: Column, pattern: str) -> Column:
    """All matches of ``pattern`` as a list."""
    return F.regexp_extract_all(col, F.lit(f"({pattern})"), 1)


def normalise_text(col: Column, cls: str = v.NORMAL_CLASS) -> Column:
    """Lower case, every character outside ``cls`` to a blank, trimmed.

    Blanks are left alone: they are the most frequent character outside the class.
    """
    return F.trim(F.regexp_replace(F.lower(col), f"[^{cls} ]", " "))


def tokenise(col: Column) -> Column:
    """Lower-case word tokens; a custom analyser goes through ``operators.models``."""
    return regex_extract(F.lower(col), f"[{v.WORD}]+")


def truncate_text(col: Column, limit: int, unit: str = "words") -> Column:
    """First ``limit`` words, or characters, of a text taken as a whole.

    Sentences are lines. By characters, sentences are trimmed and joined by a blank that
    does not count towards the limit, and the sentence that reaches it is cut.
    """
    if unit == "words":
        return F.array_join(F.slice(words(col), 1, limit), " ")
    if unit != "chars":
        raise ValueError(f"unknown unit {unit!r}")

    def step(acc: Column, sentence: Column) -> Column:
        left = F.lit(limit) - acc["used"]
        fits = F.length(sentence) < left
        gap = F.when(acc["used"] > 0, F.lit(" ")).otherwise(F.lit(""))
        kept = F.when(fits, sentence).otherwise(F.substring(sentence, F.lit(1), left))
        return F.when(acc["full"], acc).otherwise(F.struct(
            F.concat(acc["text"], gap, kept).alias("text"),
            (acc["used"] + F.length(kept)).alias("used"),
            (~fits).alias("full"),
        ))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(False).alias("full"))
    sentences = F.transform(F.split(col, "\n"), strip)
    return F.aggregate(sentences, start, step, lambda acc: acc["text"])


def truncate_sentences(col: Column, limit: int, unit: str = "words") -> Column:
    """Lines of a text until ``limit`` words, or characters, are reached.

    Whole lines are kept while their running size stays below the limit; the line that
    reaches it is cut to what is left, even to nothing, and later lines are dropped.
    """
    if unit not in ("words", "chars"):
        raise ValueError(f"unknown unit {unit!r}")
    lines = F.transform(F.split(col, "\n"), words if unit == "words" else strip)
    size_of = F.size if unit == "words" else F.length

    def cut(line: Column, n: Column) -> Column:
        if unit == "words":
            return F.array_join(F.slice(line, F.lit(1), n), " ")
        return F.substring(line, F.lit(1), n)

    def step(acc: Column, line: Column) -> Column:
        left = F.lit(limit) - acc["used"]
        fits = size_of(line) < left
        kept = cut(line, F.when(fits, size_of(line)).otherwise(left))
        return F.when(acc["full"], acc).otherwise(F.struct(
            F.concat(acc["kept"], F.array(kept)).alias("kept"),
            (acc["used"] + size_of(line)).alias("used"),
            (~fits).alias("full"),
        ))

    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"),
                     F.lit(False).alias("full"))
    return F.aggregate(lines, start, step, lambda acc: acc["kept"])
