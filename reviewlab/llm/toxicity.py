"""Toxicity by compression distance.

Two zstandard dictionaries are trained on windows of labelled texts: one on ordinary text, and one
on those parts of toxic text whose every ``GRAM`` bytes are unknown to the ordinary windows. A
window is compressed twice: with the ordinary dictionary, and with the toxic one laid over it.
The second length is shorter by what the toxic content explains and the ordinary does not; the
difference is the window's distance between the classes. A text's distances (the three largest,
their sum, the share of windows with one, and the number of windows) are mapped to a score by a
logistic calibration, fitted on labelled texts that trained no dictionary; ``DECIDE`` is the threshold.

Training is bounded: the windows of ``LABELLED`` texts of each class, of which ``SAMPLE`` are taken,
and ``CALIBRATION`` further labelled texts, all chosen by a hash. The ids of these texts are chosen
first, from ids and labels alone, so that no text is moved to meet its label. Scoring compresses
every window of every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import slices, text_bytes
from reviewlab.scale import cut_lineage

#: Bytes of a window and between the begins of windows, so that no short phrase is cut in all of them.
WINDOW, STRIDE = 96, 72
SAMPLE = 30_000
#: Labelled texts of each class that windows are cut from, and texts that the scores are calibrated on.
#: A hash picks them, so there may be a few hundredths more or fewer.
LABELLED = 20_000
CALIBRATION = 20_000
#: Bytes of text that count as known if ordinary text holds them.
GRAM = 5
ORDINARY_BYTES, TOXIC_BYTES = 64 << 10, 3 << 10
LEVEL = 12
DECIDE = 0.3
HELD_OUT = 2
FEATURES = 6


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)).cast("int")


def windows(text: bytes) -> list[bytes]:
    """All windows of a lower-cased text, one at least."""
    text = text.lower()
    return [text[p:p + WINDOW] for p in range(0, max(1, len(text) - WINDOW + STRIDE), STRIDE)]


class Distance:
    """Compression distances under the two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as z

        # A filler keeps the ordinary content as far from the window in both.
        self.coders = []
        for content in (ordinary + bytes(len(toxic)), ordinary + toxic):
            data = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.coders.append(z.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False))

    def gains(self, pieces: list[bytes]) -> np.ndarray:
        """Bytes that the toxic content saves in each window."""
        plain, both = (np.fromiter((len(c.compress(x)) for x in pieces), np.int64, len(pieces)) for c in self.coders)
        return np.maximum(plain - both, 0)

    def features(self, text: bytes) -> list[float]:
        """Largest, second and third distance, their log sum, the share of windows with one, and the log of the windows."""
        gain = self.gains(windows(text))
        top = np.sort(gain)[::-1][:3].tolist() + [0, 0]
        return [top[0], top[1], top[2], float(np.log1p(gain.sum())), float((gain > 1).mean()), float(np.log(len(gain)))]


def _content(trained: bytes) -> bytes:
    """The text part of a trained dictionary, without its tables."""
    import zstandard as z

    # Tables come first; a header of eight bytes and the entropy tables are no text.
    return trained[8:] if trained[:4] == z.MAGIC_NUMBER.to_bytes(4, "little") else trained


def residues(texts: list[bytes], known: list[bytes]) -> list[bytes]:
    """The parts of ``texts`` whose every ``GRAM`` bytes are in none of the ``known`` ones."""
    grams = {t[i:i + GRAM] for t in known for i in range(len(t) - GRAM + 1)}
    out = []
    for t in texts:
        new = [i for i in range(len(t) - GRAM + 1) if t[i:i + GRAM] not in grams]
        start = None
        for i, following in zip(new, [*new[1:], None], strict=False):
            start = i if start is None else start
            if following != i + 1:
                out.append(t[start:i + GRAM])
                start = None
    return out


def train_dictionaries(ordinary: list[bytes], toxic: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and of the toxic dictionary."""
    import zstandard as z

    def train(size: int, samples: list[bytes], width: int, step: int) -> bytes:
        samples = [s for s in samples if s]
        size = min(size, max(256, sum(map(len, samples)) // 4))
        try:
            return _content(z.train_dictionary(size, samples, k=width, d=step, level=LEVEL).as_bytes())
        except (z.ZstdError, ValueError):
            # Too little text for the trainer: the samples themselves.
            return b"".join(samples)[-size:]

    return train(ORDINARY_BYTES, ordinary, 64, 8), train(TOXIC_BYTES, residues(toxic, ordinary), 16, 6)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (bias last) by Newton steps, with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@lru_cache(maxsize=1)
def _distance(ordinary: bytes, toxic: bytes) -> Distance:
    return Distance(ordinary, toxic)


def _scorer(ordinary: bytes, toxic: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = _distance(ordinary, toxic)
        for batch in slices(batches, "_text"):
            made = [distance.features(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(made, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "_features"])
    return run


def choose_labelled(df: DataFrame, labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """(_id, _label, _fold, _order) of the sample that is learnt from, of bounded size.

    Only ids and labels are read. Ids on several rows are left out, so every id stands for one
    text; of several labels of an id the largest counts.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")) \
        .agg(F.max(F.col(label).cast("int")).alias("_label"))
    single = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n")).where("_n = 1")
    known = marks.join(single.select("_id"), "_id").where(fold("_id") != HELD_OUT).withColumns({
        "_fold": fold("_id"), "_order": F.xxhash64(F.lit("order"), "_id"),
        # The least share of the texts of its kind at which a row is in the sample.
        "_place": F.pmod(F.xxhash64(F.lit("sample"), "_id"), F.lit(1 << 40)) / float(1 << 40)})
    kinds = {(False, 0): LABELLED, (False, 1): LABELLED, (True, 0): CALIBRATION, (True, 1): CALIBRATION}
    calibrates = F.col("_fold") == 3
    # Four numbers: how many texts of each kind there are.
    sums = known.agg(*[F.count_if((calibrates == c) & (F.col("_label") == y)).alias(f"n{int(c)}{y}") for c, y in kinds]).first()
    total = sums["n10"] + sums["n11"]
    of = {(c, y): total if c else sums[f"n{int(c)}{y}"] for c, y in kinds}
    share = F.lit(0.0)
    for (c, y), most in kinds.items():
        share = F.when((calibrates == c) & (F.col("_label") == y), most / max(of[c, y], 1)).otherwise(share)
    return cut_lineage(known.where(F.col("_place") < share).drop("_place"))


def labelled(df: DataFrame, chosen: DataFrame, id_col: str, text: str) -> DataFrame:
    """(_fold, _order, _label, _text) of the texts that are learnt from; ``chosen`` is bounded."""
    rows = df.select(F.col(id_col).alias("_id"), text_bytes(text).alias("_text"))
    return rows.join(F.broadcast(chosen), "_id").drop("_id")


def _sample_windows(known: DataFrame, totals: dict[int, int], label: int) -> list[bytes]:
    """About SAMPLE windows of a class, in the order of a hash, of the texts that train dictionaries.

    A window is taken by its own hash, so tasks hand on the sample and not their best each.
    """
    cut = known.where((F.col("_label") == label) & (F.col("_fold") != 3)).select("_order", "_text", F.explode(_places()).alias("p"))
    place = F.pmod(F.xxhash64("_order", "p"), F.lit(1 << 40)) / float(1 << 40)
    chosen = cut.where(place < SAMPLE / max(totals[label], 1)).select(
        F.xxhash64("_order", "p").alias("h"), F.substring("_text", F.col("p") + 1, F.lit(WINDOW)).alias("w"))
    return [bytes(r.w).lower() for r in sorted(chosen.collect())]


def _places() -> Column:
    """Where the windows of a text begin."""
    return F.sequence(F.lit(0), F.greatest(F.octet_length("_text") - WINDOW, F.lit(0)), F.lit(STRIDE))


class Model:
    """Dictionaries and calibration."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights

    def score(self) -> Column:
        """Score of the column of features."""
        total = F.lit(float(self.weights[-1]))
        for k, w in enumerate(self.weights[:-1]):
            total = total + F.lit(float(w)) * F.col("_features")[k]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from labelled rows outside of the held-out fold; without both classes every score is 0."""
    chosen = choose_labelled(df, labels, id_col, label)
    known = labelled(df, chosen, id_col, text)
    classes = {r["_label"] for r in chosen.where(F.col("_fold") != 3).select("_label").distinct().collect()}
    if not {0, 1} <= classes:
        return Model(b"", b"", np.array([0.0] * FEATURES + [-30.0]))
    totals = {r["_label"]: r["n"] for r in known.where(F.col("_fold") != 3).groupBy("_label").agg(F.sum(F.size(_places())).alias("n")).collect()}
    ordinary, toxic = train_dictionaries(_sample_windows(known, totals, 0), _sample_windows(known, totals, 1))
    # Scored where the texts lie; only six numbers of each of the bounded sample are collected.
    tuned = known.where(F.col("_fold") == 3).select("_order", "_label", "_text")
    rows = sorted(tuned.mapInArrow(_scorer(ordinary, toxic), "_order long, _label int, _features array<double>").collect())
    x, y = np.array([r["_features"] for r in rows]).reshape(-1, FEATURES), np.array([r["_label"] for r in rows], float)
    return Model(ordinary, toxic, fit_logistic(x, y) if len(set(y)) == 2 else np.array([1.0] + [0.0] * (FEATURES - 1) + [-5.0]))


def score_toxicity(df: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, held_out, score, predicted) and columns ``keep`` of every row.

    A missing text is empty, and empty texts are scored like any other; a missing id counts as an
    empty one for its fold. Repeated rows stay; an empty table gives no rows.
    """
    names = [id_col, *[c for c in keep if c != id_col]]
    rows = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)], text_bytes(text).alias("_text"))
    kinds = [f"_k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(names)]
    scored = rows.mapInArrow(_scorer(model.ordinary, model.toxic), ", ".join([*kinds, "_features array<double>"]))
    scored = scored.withColumns({"score": model.score(), "held_out": fold("_k0") == HELD_OUT})
    return scored.select(F.col("_k0").alias(id_col), "held_out", "score", (F.col("score") >= DECIDE).cast("int").alias("predicted"),
                         *[F.col(f"_k{i}").alias(c) for i, c in enumerate(names) if i])
