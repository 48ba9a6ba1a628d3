"""Byte-level BPE by a tree of joins.

A text is halved until its parts are small. Parts are encoded alone, and neighbours are joined:
the tokens next to the seam are encoded again over a window that grows until the tokens outside
cannot change. Two rules prove that.

* Between matches of the splitting pattern: no match goes on from a character that is not white
  space into white space, nor over a change between letters, numbers and other signs (but for
  the apostrophe, which begins the contractions). Such a place is a boundary in every text
  around it, so tokens before and after it are final. A window reaches from the last such
  place before the seam to the first one after it.
* Inside one long match, where no such place is near: a sequence of tokens is the encoding of
  its bytes if and only if each token next to another one is the encoding of the two. So a
  window of tokens is final once the pairs at both its ends are.

Decoding concatenates the bytes of the tokens up the same tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import slices, whole_text

#: Characters of a part that is encoded alone, and bytes of a part of one long match.
PART = 2048
PIECE = 512
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class TreeBpe:
    """Encoder and decoder for one rank file and splitting pattern."""

    def __init__(self, path: str, pattern: str, part: int = PART, piece: int = PIECE):
        import base64

        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.base = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # The library's white space is Unicode's property; regex also counts four control characters.
        self.split = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        # Where a match ends in every text: see the module's first rule.
        space, sign = r"\p{White_Space}", r"[^\p{White_Space}\p{L}\p{N}]"
        self.final = regex.compile(rf"(?<!{space})(?<!^)(?={space})|(?<=\p{{L}})(?=\p{{N}}|{sign})|(?<=\p{{N}})(?=\p{{L}}|{sign})|"
                                   rf"(?<={sign})(?=\p{{N}})|(?<={sign})(?<!')(?=\p{{L}})")
        self.part, self.piece = part, piece
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.length_of = np.array([len(t) for t in self.bytes_of], np.int64)

    # -- one match ---------------------------------------------------------------

    def _alone(self, piece: bytes) -> list[int]:
        return self.base._core_bpe.encode_single_piece(piece) if piece else []

    def _final_pair(self, a: int, b: int) -> bool:
        return self._alone(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def _join_piece(self, left: list[int], right: list[int]) -> list[int]:
        reach = 1
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            window = self._alone(b"".join(self.bytes_of[t] for t in left[i:] + right[:j]))
            before = not i or self._final_pair(left[i - 1], window[0])
            after = j == len(right) or self._final_pair(window[-1], right[j])
            if before and after:
                return left[:i] + window + right[j:]
            reach *= 2

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of one match of the pattern, however long."""
        if len(piece) <= self.piece:
            return self._alone(piece)
        middle = len(piece) // 2
        return self._join_piece(self.encode_piece(piece[:middle]), self.encode_piece(piece[middle:]))

    # -- whole texts ---------------------------------------------------------------

    def _window(self, text: str) -> np.ndarray:
        """Tokens of a text that begins and ends at final places."""
        if len(text) <= 2 * self.part:
            return self.base.encode_to_numpy(text, disallowed_special=())
        ids: list[int] = []
        for match in self.split.finditer(text):
            ids += self.encode_piece(match[0].encode())
        return np.array(ids, np.uint32)

    def _seam(self, text: str, low: int, middle: int, high: int) -> tuple[int, int]:
        """Last final place before and first one after the seam, or the ends of the two parts."""
        reach = 32
        while True:
            a, b = max(low, middle - reach), min(high, middle + reach)
            # A place counts if the characters on both its sides belong to the part.
            start = next((p for p in reversed([m.start() for m in self.final.finditer(text, a, middle)]) if low < p), None)
            # Look-behind does not see before a match's region, so the region after begins a character early.
            stop = next((m.start() for m in self.final.finditer(text, max(low, middle - 1), b) if middle < m.start() < high), None)
            done_left, done_right = start is not None or a == low, stop is not None or b == high
            if done_left and done_right:
                return (low if start is None else start), (high if stop is None else stop)
            reach *= 4

    def _drop(self, ids: np.ndarray, count: int, last: bool) -> np.ndarray:
        """Tokens without those of ``count`` bytes at one end."""
        if not count:
            return ids
        near = min(len(ids), count)  # a token has a byte at least
        side = ids[len(ids) - near:][::-1] if last else ids[:near]
        n = int(np.searchsorted(np.cumsum(self.length_of[side]), count)) + 1
        return ids[:len(ids) - n] if last else ids[n:]

    def _encode(self, text: str, low: int, high: int) -> np.ndarray:
        if high - low <= self.part:
            return self.base.encode_to_numpy(text[low:high], disallowed_special=())
        middle = (low + high) // 2
        left, right = self._encode(text, low, middle), self._encode(text, middle, high)
        start, stop = self._seam(text, low, middle, high)
        if start == low and stop == high:
            return self._window(text[low:high])
        left = self._drop(left, len(text[start:middle].encode()), True)
        right = self._drop(right, len(text[middle:stop].encode()), False)
        return np.concatenate([left, self._window(text[start:stop]), right])

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a text, as uint32."""
        return self._encode(text, 0, len(text))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, concatenated up the tree."""
        if len(ids) <= self.part:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@lru_cache(maxsize=2)
def load(vocabulary: str) -> TreeBpe:
    """The encoder of a rank file: a name among the public tokenizers, or a path."""
    import os

    import public_tokenizers

    path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
    return TreeBpe(path, public_tokenizers.PATTERN)


def encode_documents(df: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text: str = "text",
                     keep_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the
    bytes that the ids decode to. A missing text is empty and has no tokens. Repeated rows and
    missing ids stay; an empty table gives no rows; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in slices(batches, "_text"):
            out: dict[str, Any] = {"n": [], "ids": [], "sha": [], "back": []}
            for x in batch.column(1):
                ids = bpe.encode(x.as_py())
                out["n"].append(len(ids))
                out["sha"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                out["back"].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if keep_ids:
                    out["ids"].append(ids.astype(np.int32))
            columns = [batch.column(0), pa.array(out["n"], pa.int64()), pa.array(out["sha"], pa.string()), pa.array(out["back"], pa.string())]
            names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    rows = df.select(F.col(id_col).alias("_id"), whole_text(text).alias("_text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
