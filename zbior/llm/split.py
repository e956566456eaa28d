"""Cutting texts beyond a token limit into pieces of about equal length at natural boundaries.

The least number of pieces gives equal targets; each target moves to the strongest boundary nearby
(paragraph, line, sentence, word); if any piece then breaks the limit, there is one piece more. Each piece
after the first repeats the end of the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zbior.llm.tokens import Bpe, bpe

#: Boundaries, strongest first; a piece may end and the next begin at the end of a match.
_BOUNDARIES = [re.compile(r"\n[^\S\n]*\n\s*"), re.compile(r"\n\s*"), re.compile(r"[.!?…]+[\"”’)»\]]*\s+"), re.compile(r"\s+")]


@dataclass
class Piece:
    start: int
    end: int
    tokens: int


class Splitter:
    def __init__(self, encoder: Bpe, limit: int = 1000, overlap: int = 50, slack: float = 0.15) -> None:
        if not 0 <= overlap < limit:
            raise ValueError("overlap must be less than limit")
        self.encoder, self.limit, self.overlap, self.slack = encoder, limit, overlap, slack

    def split(self, text: str | None) -> list[Piece]:
        """Pieces that cover ``text``, each within the limit; none if the whole text is within it."""
        if not text or len(text.encode()) <= self.limit:
            return []
        ids = self.encoder.encode(text)
        if len(ids) <= self.limit:
            return []
        ends = np.cumsum(self.encoder.widths[ids])
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        starts = np.concatenate([[0], np.cumsum(sizes)])  # byte at which each character starts
        at = np.searchsorted(ends, starts, "right")  # token in which each character starts
        whole = np.isin(starts, np.concatenate([[0], ends]))  # characters that start with a token
        cuts = np.zeros(len(text) + 1, np.int8)
        for strength, pattern in zip((1, 2, 3, 4), reversed(_BOUNDARIES), strict=True):
            cuts[[m.end() for m in pattern.finditer(text)]] = strength
        cuts[0] = cuts[-1] = 0
        n, count = len(ids), -(-(len(ids) - self.overlap) // (self.limit - self.overlap))
        while True:
            pieces = self._place(text, n, count, at, whole, cuts)
            if pieces is not None:
                return pieces
            count += 1

    def _place(self, text: str, n: int, count: int, at: np.ndarray, whole: np.ndarray, cuts: np.ndarray) -> list[Piece] | None:
        hard = count > n  # a token a piece: nothing gives way any more, cut where a character ends
        pieces, start, last = [], 0, 0
        while True:
            if n - at[start] <= self.limit + 8 and (rest := len(self.encoder.encode(text[start:]))) <= self.limit:
                return [*pieces, Piece(start, len(text), rest)]
            left = max(1, count - len(pieces))
            if left == 1 and not hard:
                return None
            length = (n - at[start] + self.overlap * (left - 1)) / left
            width, target = max(1, int(length * self.slack)), at[start] + length
            enough = n - (left - 1) * (self.limit - self.overlap)  # a cut before would leave too much for the rest
            top = at[start] + self.limit
            low, high = np.searchsorted(at, [min(max(target - width, enough), top), min(target + width, top)], "left")
            low = max(int(low), last + 1)
            near = np.arange(low, min(int(high), len(text) - 1) + 1)
            if not (cuts[near] > 0).any():  # the nearest boundary anywhere within the limit
                far = np.arange(last + 1, min(int(np.searchsorted(at, top, "right")), len(text)))
                far = far[cuts[far] > 0]
                for end in far[np.argsort(np.abs(at[far] - target), kind="stable")].tolist():
                    if len(self.encoder.encode(text[start:end])) <= self.limit:
                        near = np.array([end])
                        break
            while True:
                best = near[cuts[near] > 0]
                if len(best):
                    best = best[cuts[best] == cuts[best].max()]
                else:
                    best = near[whole[near]] if whole[near].any() else near
                if not len(best):
                    break
                end = int(best[np.argmin(np.abs(at[best] - target))])
                used = len(self.encoder.encode(text[start:end]))
                if used <= self.limit:
                    break
                near = near[near < end]
            if not len(best):  # nothing beyond the last piece fits: give up its repetition, then the limit
                if start < last:
                    start = last
                    continue
                end = start + 1
                used = len(self.encoder.encode(text[start:end]))
            pieces.append(Piece(start, end, used))
            start, last = self._repeat(start, end, at, whole, cuts), end

    def _repeat(self, start: int, end: int, at: np.ndarray, whole: np.ndarray, cuts: np.ndarray) -> int:
        """Where the next piece starts: at most ``overlap`` tokens before ``end``, at a boundary if there is one."""
        if not self.overlap:
            return end
        low = max(int(np.searchsorted(at, at[end] - self.overlap, "left")), start + 1)
        near = np.arange(low, end)
        for good in (near[cuts[near] > 0], near[whole[near]]):
            if len(good):
                return int(good[0])
        return end


SCHEMA = "doc_id long, piece_no int, start_char int, end_char int, n_tokens int, text string"


def split_oversized(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 1000, overlap: int = 50, vocabulary: str | None = None) -> DataFrame:
    """The pieces of every text beyond ``limit`` tokens; texts within it, null and empty ones give no row.

    Pieces cover the text in order; each has at most ``limit`` tokens and starts at most ``overlap`` tokens
    before the end of the one before. Where no white space is near, the cut falls between tokens, at the
    end of a character. Repeated rows give their pieces again. A text of no more than ``limit`` bytes has no
    more than ``limit`` tokens and never leaves the JVM.
    """
    todo = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter(F.octet_length("text") > limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(bpe(vocabulary), limit, overlap)
        schema = pa.schema([("doc_id", pa.int64()), ("piece_no", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("n_tokens", pa.int32()), ("text", pa.string())])
        for batch in batches:
            rows = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(doc, i, p.start, p.end, p.tokens, t[p.start : p.end]) for i, p in enumerate(splitter.split(t))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return todo.mapInArrow(run, SCHEMA)
