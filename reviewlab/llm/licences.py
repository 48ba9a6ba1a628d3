"""Licence scan: Dice coefficient over word bigrams between text units and licence notices.

Units of a text are its lines and, where a paragraph has several lines, its paragraphs. Words
are runs of letters, digits and all that is not ASCII; A-Z are lower-cased and "licence" is read
as "license". A Dice value of
t or more needs bigram counts within a factor of (2 - t) / t, so a unit is compared with those
notices only that its count allows, and only if it holds a word without which no notice can
reach t (see ``notice_table``); both prunings are exact. All work is done within the row; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import whole_text
from reviewlab.scale import compute_once

#: Wordings of common licence notices.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "Apache-2.0-header": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "MIT-text": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:",
                     "Licensed under the BSD 3-Clause License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring "
                "rights to this work."],
}


UPPER = "".join(map(chr, range(65, 91)))
OTHER = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c != "\n")
#: Words that are frequent in any English text.
FREQUENT = frozenset("the a an of and or to in is are by under with this that it as for at on you may be not 0 1 2 3 4 v".split())


def size_bounds(n: int, least: float) -> tuple[int, int]:
    """Bigram counts that allow a Dice value of ``least`` with a set of ``n``."""
    ratio = least / (2 - least)
    return -int(-n * ratio // 1), int(n / ratio)


def notice_table(notices: Mapping[str, list[str]], least: float) -> list[dict]:
    """One entry per notice: its bigrams, how often the repeated ones stand in it, size bounds, and signs.

    A match has at least ``shared`` bigrams in common with the notice. So few bigrams of the notice
    are without a sign that every match holds one of its signs as a word.
    """
    out = []
    for name, texts in notices.items():
        for text in texts:
            words = re.findall("[a-z0-9]+", text.lower().replace("licence", "license"))
            counts = Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))
            n = counts.total()
            low, high = size_bounds(n, least)
            shared = -int(-least * (low + n) / 2 // 1)
            bare, signs = Counter(counts), []
            while bare.total() >= shared:
                holds = Counter(w for b, c in bare.items() for w in set(b.split()) for _ in range(c))
                signs.append(min(holds, key=lambda w: (w in FREQUENT, -holds[w] * len(w), w)))  # noqa: B023
                bare = Counter({b: c for b, c in bare.items() if signs[-1] not in b.split()})
            out.append({"name": name, "n": n, "low": low, "high": high, "bigrams": sorted(counts), "signs": signs,
                        "again": {b: c for b, c in sorted(counts.items()) if c > 1}})
    return out


def clean_lines(text: str) -> Column:
    """Lines of words in lower case, with a space for every other ASCII character."""
    return F.replace(F.translate(whole_text(text), UPPER + OTHER, UPPER.lower() + " " * len(OTHER)),
                     F.lit("licence"), F.lit("license"))


def _units(clean: Column) -> Column:
    """Lines, then paragraphs that have several lines."""
    lines = F.transform(F.split(clean, "\n"), lambda x: F.trim(F.regexp_replace(x, " +", " ")))
    parts = F.filter(F.split(clean, "\n *\n[ \n]*"), lambda p: p.contains("\n"))
    return F.concat(lines, F.transform(parts, lambda p: F.trim(F.regexp_replace(p, "[ \n]+", " "))))


def _matches(units: Column, entries: list[dict], least: float) -> Column:
    low, high = min(e["low"] for e in entries), max(e["high"] for e in entries)

    def fits(x: Column) -> Column:
        return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).between(max(1, low), high)

    def with_bigrams(x: Column) -> Column:
        words = F.split(x, " ")
        pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1),
                           lambda a, b: F.concat(a, F.lit(" "), b))
        return F.struct(x.alias("unit"), pairs.alias("pairs"))

    def held(u: Column, pair: str) -> Column:
        return F.size(F.filter(u["pairs"], lambda p: p == F.lit(pair)))

    def against(u: Column) -> Column:
        n = F.size(u["pairs"])
        found = []
        for e in entries:
            common = F.size(F.array_intersect(u["pairs"], F.array(*[F.lit(b) for b in e["bigrams"]])))
            for b, times in e["again"].items():
                common = common + F.greatest(F.least(held(u, b), F.lit(times)) - 1, F.lit(0))
            dice = F.lit(2.0) * common / (n + e["n"])
            # Evaluated only where the bounds hold.
            found.append(F.when(n.between(e["low"], e["high"]), F.struct(
                (-dice).alias("neg"), F.lit(e["name"]).alias("licence"), u["unit"].alias("unit"))))
        return F.filter(F.array(*found), lambda m: m.isNotNull() & (m["neg"] <= -least))

    return F.flatten(F.transform(F.transform(F.filter(units, fits), with_bigrams), against))


def scan_licences(df: DataFrame, least: float = 0.8, notices: Mapping[str, list[str]] = NOTICES,
                  id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, licence, dice, unit, n_matches) for every row.

    The best match of a text is its highest Dice value, then the first licence and unit in
    alphabetical order; without a match of ``least`` or more, licence, dice and unit are missing
    and n_matches is 0, as for a missing or empty text. n_matches counts (unit, notice) pairs.
    Repeated rows and ids stay; other columns are not read.
    """
    entries = notice_table(notices, least)
    clean = compute_once(df.select(F.col(id_col), F.col(text).alias("_text")), {"_clean": clean_lines("_text")})
    signs = F.array(*[F.lit(w) for w in sorted({w for e in entries for w in e["signs"]})])
    signed = F.arrays_overlap(F.split(F.translate("_clean", "\n", " "), " "), signs)
    matches = _matches(_units(F.col("_clean")), entries, least)
    none = F.array().cast("array<struct<neg:double,licence:string,unit:string>>")
    found = compute_once(clean.drop("_text"), {"_found": F.when(signed, matches).otherwise(none)})
    best = F.array_min("_found")
    return found.select(id_col, best["licence"].alias("licence"), (-best["neg"]).alias("dice"), best["unit"].alias("unit"),
                        F.size("_found").cast("long").alias("n_matches"))
