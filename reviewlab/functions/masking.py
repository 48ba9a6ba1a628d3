"""Masking of personal data in reply texts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlab import values as v


def _quoted(col: Column) -> Column:
    """Regular expression that matches the text of ``col`` literally."""
    safe = F.replace(col, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("\\Q"), safe, F.lit("\\E"))


NEVER = "(?!)"


def any_of(literals: Column) -> Column:
    """Pattern of an array of literals, first listed wins; empty ones are left out.

    Matches nothing where no literal is left, so the text needs no test of its own and
    appears once in the expression.
    """
    usable = F.filter(literals, lambda x: x.isNotNull() & (x != ""))
    pattern = F.array_join(F.transform(usable, _quoted), "|")
    return F.coalesce(F.nullif(pattern, F.lit("")), F.lit(NEVER))


def customer_forms(customer_id: Column) -> Column:
    """Spellings of a starred id: whole, without its last character, and shorter.

    Characters are cut from the form in which every star is written with a backslash, so
    the third form of ``aa**님`` is ``aa*``.
    """
    escaped = F.replace(customer_id, F.lit("*"), F.lit("\\*"))

    def cut(n: int) -> Column:
        kept = F.substring(escaped, F.lit(1), F.greatest(F.length(escaped) - n, F.lit(0)))
        return F.replace(F.regexp_replace(kept, r"\\$", ""), F.lit("\\*"), F.lit("*"))

    return F.array(customer_id, cut(1), cut(3))


def _from_run_start(cls: str) -> str:
    """Start of a run of ``cls`` characters, or the end of the previous match.

    A pattern that begins with ``cls+`` and fails there fails at every later character of
    the run as well, so trying those is saved without changing what is found.
    """
    return rf"(?:(?<![{cls}])|\G)"


CALL_CLASS = f"ㄱ-ㅎ가-힣{v.WORD}"
GUEST_CALL = rf"{_from_run_start(CALL_CLASS)}[{CALL_CLASS}]+(\*\*)* *(님|고객님)"


def mask_customer(text: Column, customer_id: Column) -> Column:
    """Replace the row's own customer id; guests are found by the form of address."""
    pattern = F.when(customer_id == v.GUEST_ID, GUEST_CALL).otherwise(any_of(customer_forms(customer_id)))
    return F.regexp_replace(text, pattern, F.lit(v.CUSTOMER))


def store_forms(store: Column) -> Column:
    """Whole name, name with blanks for hyphens, then each part."""
    parts = F.split(store, "-")
    return F.concat(F.array(store, F.array_join(parts, " ")), parts)


def mask_store(text: Column, store: Column) -> Column:
    """Replace the row's own store name, then merge adjacent store masks."""
    masked = F.regexp_replace(text, any_of(store_forms(store)), F.lit(v.STORE))
    return F.regexp_replace(masked, f"({v.STORE}){{2,}}", v.STORE)


def terms_pattern(terms: Sequence[str], quote: bool = True) -> str:
    """Alternation of terms, the first listed wins.

    Quoted terms are preceded by a look at their first characters, so a position where
    none can start costs one test and not one per term.
    """
    if not quote:
        return "|".join(terms)
    terms = [t for t in terms if t]
    if not terms:
        return NEVER
    initials = "".join(f"\\x{{{ord(c):x}}}" for c in sorted({t[0] for t in terms}))
    return f"(?=[{initials}])(?:{'|'.join(map(re.escape, terms))})"


def mask_terms(text: Column, terms: Sequence[str], mask: str, quote: bool = True) -> Column:
    """Replace listed terms, the first listed wins; ``quote=False`` reads them as patterns."""
    return F.regexp_replace(text, terms_pattern(terms, quote), mask)


def mask_handles(text: Column) -> Column:
    return F.regexp_replace(text, "@[a-zA-Z0-9_]+", v.CONTACT)


def mask_phones(text: Column) -> Column:
    return F.regexp_replace(text, rf"(2\.[{v.WORD}.]+)|(010-[{v.WORD}-]+)", v.CONTACT)


def mask_urls_emails(text: Column) -> Column:
    """Web and mail addresses; the character before ``com`` may be any."""
    cls = f"{v.WORD}/:.@"
    return F.regexp_replace(text, rf"{_from_run_start(cls)}[{cls}]+.com[{v.WORD}/.]*", v.CONTACT)


def mask_tagged(text: Column, entities: Column) -> Column:
    """Replace tagged terms of one row: organisations first, then places.

    ``entities`` is array<struct<word, type>>. Terms that hold a mask character are left
    out; longer terms are tried first.
    """
    def terms(kind: str) -> Column:
        usable = F.filter(entities, lambda e: (e["type"] == kind) & ~e["word"].contains("#")
                          & ~e["word"].contains("@"))
        ranked = F.sort_array(F.array_distinct(F.transform(
            usable, lambda e: F.struct((-F.length(e["word"])).alias("n"), e["word"].alias("word")))))
        return F.transform(ranked, lambda e: e["word"])

    organised = F.regexp_replace(text, any_of(terms("ORGANIZATION")), F.lit(v.ORGANISATION))
    return F.regexp_replace(organised, any_of(terms("LOCATION")), F.lit(v.PLACE))


def unmask_reply(text: Column, store: Column, customer: Column) -> Column:
    """Reply ready to show: own names back in, place mask and model tokens deleted.

    Organisation and contact masks stay. The first literal is deleted as it stands, not
    read as a pattern.
    """
    out = F.replace(text, F.lit("[a-zA-Z]+"), F.lit(""))
    out = F.replace(out, F.lit(v.STORE), store)
    out = F.replace(out, F.lit(v.CUSTOMER), customer)
    for literal in (v.PLACE, "<unk>", "</s>"):
        out = F.replace(out, F.lit(literal), F.lit(""))
    return F.replace(out, F.lit("\n"), F.lit(" "))
