"""Lines repeated across one source's documents, by content-defined chunks.

A document is cut not at fixed places but where a rolling hash of the last 16 characters says so, after each
line is brought to the form in which lines are compared. The hash never reaches over a line's start, where there
is a cut as well: short lines could not be told from their neighbours else. A line is thus a sequence of chunks, and
equal lines are equal sequences. Chunks are counted in distinct documents for each source; lines that begin
and end with chunks that recur often enough are then compared as whole sequences, as the definition of a case demands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zbior.llm import rolling
from zbior.session import cut_lineage, written

#: Characters that decide about a cut, and one place in how many is a cut.
WINDOW, RATE = 16, 32
#: Most recurring chunks that are sent to every executor; beyond it, the lines' chunks are shuffled to them.
BROADCAST_CHUNKS = 2_000_000

_DIGITS = re.compile(r"\d+")


def comparable(line: str) -> str:
    """``line`` without letter case, outer white space, kinds of inner white space and values of digits."""
    return _DIGITS.sub("0", " ".join(line.lower().split()))


def chunk_lines(lines: list[str]) -> list[list[int]]:
    """Digests of each line's chunks, in order."""
    points, starts = rolling.code_points(lines)
    inside = np.arange(len(points)) - np.repeat(starts[:-1], np.diff(starts))
    cut = (inside >= WINDOW - 1) & (rolling.mix(rolling.gear(points, WINDOW)) % np.uint64(RATE) == 0)
    ends = np.flatnonzero(cut) + 1
    at, out = np.searchsorted(ends, starts).tolist(), []
    ends = ends.tolist()
    for i, line in enumerate(lines):
        s = int(starts[i])
        marks = sorted({*(e - s for e in ends[at[i] : at[i + 1]]), len(line)} - {0})
        out.append([_signed(xxhash.xxh3_64_intdigest(line[x:y].encode())) for x, y in zip([0, *marks], marks, strict=False)])
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _lines(df: DataFrame, key: str, document: str, source: str, text: str) -> DataFrame:
    """``key``, ``src``, ``doc`` (hashes), ``line_no`` (from 1) and ``chunks`` (digests, in order) of every line that is not blank."""
    kind = df.schema[key].dataType.simpleString()
    hashed = lambda c: F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0")))
    todo = df.select(F.col(key).alias("key"), hashed(source).alias("src"), F.when(F.col(document).isNotNull(), hashed(document)).alias("doc"), F.col(text).cast("string").alias("text")).filter(F.length("text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                rows, numbers, lines = [], [], []
                for r, text in enumerate(part.column(3).to_pylist()):
                    for n, line in enumerate(text.split("\n"), 1):
                        if plain := comparable(line):
                            rows.append(r)
                            numbers.append(n)
                            lines.append(plain)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(take) for c in range(3)), pa.array(numbers, pa.int64()), pa.array(chunk_lines(lines) if lines else [], pa.list_(pa.int64()))],
                    ["key", "src", "doc", "line_no", "chunks"],
                )

    return todo.mapInArrow(run, f"key {kind}, src long, doc long, line_no long, chunks array<long>")


def repeated_lines(df: DataFrame, key: str, document: str, source: str, text: str, at_least: int = 6) -> DataFrame:
    """``key`` and ``line_no`` of every line that occurs in ``at_least`` different documents of one source.

    Rows are documents as fetched; ``document`` names the document itself, so that one fetched twice counts
    once. Null and empty texts have no lines, blank lines count in ``line_no`` but are never reported; a null
    source is a source, a null document is none. A repeated row's lines come out once. Counts are
    aggregated before they are shuffled, so a chunk that is in every document costs each task one row.
    Documents, sources and chunks travel as 64-bit hashes, never as text: only a collision with one of the few
    recurring chunks could tell, not one among all. Texts are read and hashed once.
    """
    lines = written(_lines(df, key, document, source, text))
    chunks = lines.select("src", "doc", F.explode("chunks").alias("chunk"))
    often = cut_lineage(chunks.groupBy("src", "chunk").agg(F.count_distinct("doc").alias("docs")).filter(F.col("docs") >= at_least).select("src", "chunk"))
    if often.count() <= BROADCAST_CHUNKS:
        often = F.broadcast(often)
    near = lines
    for end in (1, -1):
        near = near.withColumn("chunk", F.element_at("chunks", end)).join(often, ["src", "chunk"], "left_semi").drop("chunk")
    near = near.select("key", "src", "doc", "line_no", F.xxhash64("chunks", F.size("chunks")).alias("line"))
    same = near.groupBy("src", "line").agg(F.count_distinct("doc").alias("docs")).filter(F.col("docs") >= at_least).select("src", "line")
    return near.join(same, ["src", "line"], "left_semi").select(F.col("key").alias(key), "line_no").distinct()


def without_lines(df: DataFrame, key: str, text: str, lines: DataFrame) -> DataFrame:
    """``df`` with ``clean`` (``text`` without the given lines) and ``n_cut``; nulls stay null, other lines as they are."""
    cut = lines.groupBy(key).agg(F.collect_set("line_no").alias("__cut"))
    rest = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.coalesce(F.array_contains("__cut", (i + 1).cast("long")), F.lit(False)))
    return df.join(cut, key, "left").withColumn("clean", F.array_join(rest, "\n")).withColumn("n_cut", F.coalesce(F.size("__cut"), F.lit(0)).cast("long")).drop("__cut")
