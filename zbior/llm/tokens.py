"""Encoding of whole texts with a public byte-level BPE, by tree reduction.

A text is halved until the pieces are short; each piece is encoded by itself, and neighbours are joined:
only a window around the seam is encoded again. The window grows until both its ends are places where
every split of the text into words must begin a new word (white space after something else, which no
word of the pattern spans), so that the tokens outside provably stay what they are. The join is
associative, and decoding just concatenates.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters up to which a piece is encoded directly.
LEAF = 4096

_SEAM = re.compile(r"\S(?=[ \n])")


def default_vocabulary() -> str:
    """Path of the ranks of byte_bpe_50k; every executor has the installed package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Bpe:
    """``encode`` and ``decode`` by the ranks in a tiktoken file; nothing is a special token."""

    def __init__(self, path: str | None = None, leaf: int = LEAF) -> None:
        import public_tokenizers
        import tiktoken

        with open(path or default_vocabulary(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.widths[list(ranks.values())] = [len(x) for x in ranks]
        self.leaf = leaf

    def encode(self, text: str | None) -> list[int]:
        """The ids of ``text``; null and empty texts have none."""
        return self._span(text, 0, len(text)) if text else []

    def decode(self, ids: list[int]) -> str:
        return self.core.decode(ids)

    def _span(self, text: str, low: int, high: int) -> list[int]:
        if high - low <= self.leaf:
            return self.core.encode_ordinary(text[low:high])
        middle = (low + high) // 2
        return self._join(text, low, middle, high, self._span(text, low, middle), self._span(text, middle, high))

    def _join(self, text: str, low: int, middle: int, high: int, left: list[int], right: list[int]) -> list[int]:
        begin, end = self._sync_before(text, low, middle), self._sync_after(text, middle, high)
        keep = len(left) - self._covering(reversed(left), len(text[begin:middle].encode()))
        skip = self._covering(iter(right), len(text[middle:end].encode()))
        return left[:keep] + self.core.encode_ordinary(text[begin:end]) + right[skip:]

    def _covering(self, ids: Iterator[int], size: int) -> int:
        n = 0
        while size > 0:
            size -= self.widths[next(ids)]
            n += 1
        return n

    @staticmethod
    def _sync_before(text: str, low: int, middle: int) -> int:
        """The last place before ``middle`` where a word must begin, or ``low``."""
        width, at = 64, middle
        while at > low:
            at = max(low, middle - width)
            seams = [m.end() for m in _SEAM.finditer(text, at, middle) if not m[0].isspace()]
            if seams:
                return seams[-1]
            width *= 2
        return low

    @staticmethod
    def _sync_after(text: str, middle: int, high: int) -> int:
        """The first place after ``middle`` where a word must begin, or ``high``."""
        return next((m.end() for m in _SEAM.finditer(text, middle, high) if not m[0].isspace() and m.end() < high), high)


@lru_cache(maxsize=4)
def bpe(path: str | None = None, leaf: int = LEAF) -> Bpe:
    """One encoder for each worker process."""
    return Bpe(path, leaf)


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str | None = None, leaf: int = LEAF) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row; null and empty texts have an empty list.

    Row by row: repeated rows come out again, a null key is kept, an empty table gives no row. A text is
    encoded whole, however long. ``vocabulary`` is a tiktoken file that every executor can read.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe(vocabulary, leaf).encode
        for batch in batches:
            ids = [encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.fromiter((i for x in ids for i in x), np.int32, ends[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [key, "ids"])

    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
