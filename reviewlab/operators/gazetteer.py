"""Terms of a gazetteer of any size, wherever they stand in a text.

A gazetteer measured below ``AUTOMATON_BYTES`` is sent to the tasks, each of which builds one Aho-Corasick
automaton and passes once over each text, however many terms there are. A larger one is never
sent: of each term the gram of ``GRAM`` characters that the fewest terms have is its anchor; the grams of
the texts, one per place, meet the anchors in a join, and each meeting is compared with the whole term.
Both ways find the same occurrences, and the same function replaces them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab import values as v
from reviewlab.scale import lookup_join, table_bytes

AUTOMATON_BYTES = 8 << 20
GRAM = 3
KINDS = ("ORGANIZATION", "LOCATION")


def usable_terms(gazetteer: DataFrame) -> DataFrame:
    """(term, org, place) of the terms that are masked: not empty, and without the characters of masks."""
    ours = gazetteer.where(~F.col("term").rlike("[#@]") & (F.col("term") != "") & F.col("type").isin(*KINDS))
    return ours.groupBy("term").agg(*[F.max(F.col("type") == kind).alias(name) for kind, name in zip(KINDS, ("org", "place"), strict=True)])


# ------------------------------------------------------------------ replacing

Span = tuple[int, int, bool, bool]  # start, length, organisation, place


def leftmost_longest(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of (start, length), from the left the longest at each place, none within another."""
    out, free = [], 0
    for start, n in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= free:
            out.append((start, n))
            free = start + n
    return out


def mask_spans(text: str, found: Sequence[Span], organisation: str) -> str:
    """Organisations are replaced first, then places in what is left; ``organisation`` is the first mask as it reads then."""
    if not found:
        return text
    orgs = leftmost_longest((s, n) for s, n, org, _ in found if org)
    ends = [s + n for s, n in orgs]
    starts = [s for s, _ in orgs]
    # Of the organisations, only the first that ends after a place's begin can touch it.
    after = np.searchsorted(ends, [s for s, _, _, place in found if place], "right")
    places = [(s, n) for (s, n, _, _), k in zip((f for f in found if f[3]), after.tolist(), strict=True)
              if k == len(orgs) or starts[k] >= s + n]
    pieces, free = [], 0
    for s, n, mask in sorted([(s, n, organisation) for s, n in orgs] + [(s, n, v.PLACE) for s, n in leftmost_longest(places)]):
        pieces += [text[free:s], mask]
        free = s + n
    return "".join([*pieces, text[free:]])


def place_in_mask(spans: Iterable[Span]) -> str:
    """The mask of organisations after places that stand in it were replaced in turn."""
    return mask_spans(v.ORGANISATION, [(s, n, False, True) for s, n, _, place in spans if place], v.ORGANISATION)


# ------------------------------------------------------------------ automaton

class Finder:
    """Aho-Corasick automaton over (term, org, place)."""

    def __init__(self, terms: Iterable[tuple[str, bool, bool]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, org, place in terms:
            self.automaton.add_word(term, (len(term), org, place))
        self.automaton.make_automaton()
        self.organisation = place_in_mask(self.spans(v.ORGANISATION))

    def spans(self, text: str) -> list[Span]:
        if not len(self.automaton):
            return []
        return [(end + 1 - n, n, org, place) for end, (n, org, place) in self.automaton.iter(text)]


def mask_by_automaton(df: DataFrame, col: str, terms: Sequence[tuple[str, bool, bool]]) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(terms)

    @F.arrow_udf("string")
    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = Finder(sent.value)
        for texts in batches:
            yield pa.array([None if t is None else mask_spans(t, finder.spans(t), finder.organisation) for t in texts.to_pylist()], pa.string())

    return df.withColumn(col, masked(F.col(col)))


# ---------------------------------------------------------------------- grams

def gram_codes(text: str, n: int) -> np.ndarray:
    """The n characters, 3 at most, that begin at each place, as one number of 21 bits each."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    code = np.zeros(max(len(points) - n + 1, 0), np.int64)
    for k in range(n):
        code = code << 21 | points[k:k + len(code)]
    return code


def grams_of(df: DataFrame, text: str, keep: Sequence[str], sizes: Sequence[int] | None) -> DataFrame:
    """(keep.., code, at, size) for every place of every text; ``sizes`` None: GRAM, or the whole of shorter texts."""
    fields = df.select(*keep).schema.fields
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "code long", "at int", "size int"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column(len(keep)).to_pylist()):
                for n in (sizes or [min(len(t), GRAM)]) if t else []:
                    code = gram_codes(t, n)
                    if len(code):
                        row = batch.slice(i, 1)
                        same = [row.column(k).take(pa.array(np.zeros(len(code), np.int32))) for k in range(len(keep))]
                        yield pa.record_batch([*same, pa.array(code), pa.array(np.arange(len(code), dtype=np.int32)),
                                               pa.array(np.full(len(code), n, np.int32))], [*keep, "code", "at", "size"])

    return df.select(*keep, text).mapInArrow(work, schema)


def find_substrings(df: DataFrame, col: str, terms: DataFrame, row_id: str = "review_id", **scale: int) -> DataFrame:
    """(row_id, start, term, org, place): places where a term may stand, by its anchor; to be compared with the text."""
    grams = grams_of(terms, "term", ["term", "org", "place"], None)
    held = grams.groupBy("code", "size").agg(F.count_distinct("term").alias("n"))
    rarest = F.min_by(F.struct("code", "size", "at"), F.struct("n", "at"))
    anchors = grams.join(held, ["code", "size"]).groupBy("term", "org", "place").agg(rarest.alias("a"))
    anchors = anchors.select("term", "org", "place", "a.code", "a.size", F.col("a.at").alias("offset"))
    # At most GRAM numbers.
    sizes = sorted(r["size"] for r in anchors.select("size").distinct().collect())
    places = grams_of(df, col, [row_id], sizes or [GRAM])
    met = lookup_join(places, anchors, ["code", "size"], [row_id, "at"], **scale)
    return met.select(row_id, (F.col("at") - F.col("offset")).alias("start"), "term", "org", "place").where("start >= 0")


def mask_by_grams(df: DataFrame, col: str, terms: DataFrame, row_id: str, **scale: int) -> DataFrame:
    found = find_substrings(df, col, terms, row_id, **scale)
    per_row = found.groupBy(row_id).agg(F.collect_list(F.struct("start", "term", "org", "place")).alias("_found"))
    # Terms that stand in the mask of organisations: of its inner characters, a handful.
    inner = v.ORGANISATION.strip("#@")
    parts = {inner[i:j] for i in range(len(inner)) for j in range(i + 1, len(inner) + 1)}
    own = [r.term for r in terms.where(F.col("term").isin(*parts) & F.col("place")).collect()]
    organisation = Finder((t, False, True) for t in own).organisation

    @F.arrow_udf("string")
    def masked(texts: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts.to_pylist(), places.to_pylist(), strict=True):
            spans = [(p["start"], len(p["term"]), p["org"], p["place"]) for p in found or [] if text.startswith(p["term"], p["start"])]
            out.append(None if text is None else mask_spans(text, spans, organisation))
        return pa.array(out, pa.string())

    return df.join(per_row, row_id, "left").withColumn(col, masked(F.col(col), F.col("_found"))).drop("_found")


def mask_substrings(df: DataFrame, col: str, gazetteer: DataFrame, row_id: str = "review_id", automaton_bytes: int = AUTOMATON_BYTES,
                    **scale: int) -> DataFrame:
    """Replace gazetteer terms wherever they stand, the longest at each place from the left."""
    terms = usable_terms(gazetteer)
    if table_bytes(terms) <= automaton_bytes:
        return mask_by_automaton(df, col, [tuple(t) for t in terms.select("term", "org", "place").collect()])
    return mask_by_grams(df, col, terms, row_id, **scale)
