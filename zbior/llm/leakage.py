"""Passages of evaluation items inside documents, by greedy string tiling.

Words of a document become the numbers of the items' words; Karp-Rabin hashes of every run of
``min_match`` numbers are looked up among those of the items, which gives the seeds. For each document and
item with a seed the longest matches that do not overlap are marked as tiles, longest first, until none
of ``min_match`` words is left. Tiles of a reordered passage add up to its coverage of the item.

Items that fit into one block go to every executor; of more, hashes of sampled short runs are joined to those of the
documents, and only texts that share one meet.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zbior.llm import rolling
from zbior.session import cut_lineage

#: Most megabytes of item texts that are sent to every executor; more are joined by the hashes of sampled runs.
BLOCK_MB = 16

_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃿︠-︯]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, without case and diacritics (ł = l)."""
    if not text:
        return []
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFD", text))
    return _WORD.findall(text.lower().replace("ł", "l"))


class Items:
    """Items (id, text) indexed by the hashes of their runs of ``min_match`` words; of one id with several texts each is an item."""

    def __init__(self, items: list[tuple[int, str | None]], min_match: int) -> None:
        self.min_match, self.number = min_match, {}
        self.ids = [item for item, _ in items]
        self.texts: list[list[int]] = []
        hashes, places = [], []
        for n, (_, text) in enumerate(items):
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            self.texts.append(ids)
            if len(ids) >= min_match:
                h = rolling.polynomial(np.array(ids), min_match)[: len(ids) - min_match + 1]
                hashes.append(h)
                places += [(n, i) for i in range(len(h))]
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.hashes, inverse = np.unique(every, return_inverse=True)
        self.places: list[list[tuple[int, int]]] = [[] for _ in self.hashes]
        for k, place in zip(inverse.tolist(), places, strict=True):
            self.places[k].append(place)

    def seeds(self, texts: list[str | None]) -> Iterator[tuple[int, list[int], list[tuple[int, int]]]]:
        """(index of the text, its word numbers, (position, hash index) of each seed) of every text with a seed."""
        if not len(self.hashes):
            return
        get = self.number.get
        numbers = [[get(w, 0) for w in words(t)] for t in texts]
        starts = np.cumsum([0, *[len(x) + 1 for x in numbers]])
        flat = np.zeros(starts[-1], np.int64)
        for s, x in zip(starts.tolist(), numbers, strict=False):
            flat[s : s + len(x)] = x
        if len(flat) < self.min_match:
            return
        known = np.concatenate([[0], np.cumsum(flat == 0)])
        n = len(flat) - self.min_match + 1
        full = np.flatnonzero(known[self.min_match :] == known[:n])
        h = rolling.polynomial(flat, self.min_match)[full]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        by = defaultdict(list)
        for p, k in zip(full[hit].tolist(), at[hit].tolist(), strict=True):
            by[int(np.searchsorted(starts, p, "right")) - 1].append((p, k))
        for d, found in by.items():
            yield d, numbers[d], [(p - int(starts[d]), k) for p, k in found]

    def tiles(self, doc: list[int], seeds: list[tuple[int, int]]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(number of the item, tiles as (length, document position, item position)) of each item, longest tile first."""
        by = defaultdict(list)
        for p, k in seeds:
            for n, q in self.places[k]:
                by[n].append((p, q))
        for n, pairs in by.items():
            tiles = _tile(doc, self.texts[n], pairs, self.min_match)
            if tiles:
                yield n, tiles

    def leaks(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(index of the text, item id, tiles, words of the longest, of all, of the item) of every text and item that share a run."""
        for d, numbers, seeds in self.seeds(texts):
            for n, t in self.tiles(numbers, seeds):
                yield d, self.ids[n], len(t), t[0][0], sum(x[0] for x in t), len(self.texts[n])


def _tile(a: list[int], b: list[int], seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    free_a, free_b, tiles = [True] * len(a), [True] * len(b), []
    while True:
        matches, reached = [], {}
        for i, j in seeds:
            if reached.get(i - j, -1) > i or not (free_a[i] and free_b[j]):
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                n += 1
            reached[i - j] = i + n
            if n >= least:
                matches.append((n, i, j))
        if not matches:
            return tiles
        for n, i, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if all(free_a[i : i + n]) and all(free_b[j : j + n]):
                free_a[i : i + n] = [False] * n
                free_b[j : j + n] = [False] * n
                tiles.append((n, i, j))


_NAMES = ["doc_id", "item_id", "tiles", "longest", "covered", "item_words"]
_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
SCHEMA = "doc_id long, item_id long, tiles int, longest int, covered int, item_words int"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, _TYPES, strict=True)], _NAMES)


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "item_text", min_match: int = 8, block_mb: float = BLOCK_MB) -> DataFrame:
    """For each document and item with a common run of ``min_match`` words: number of tiles, words in the longest and in all.

    Distinct rows. Items of up to ``block_mb`` in all are sent to every executor, against which documents are read
    without a shuffle; of more, nothing but their measured size reaches the driver. Null, empty and short texts and
    items match nothing, nor do rows without a key; repeated rows give their matches once; of one id with several texts each counts.
    """
    size = items.agg(F.sum(F.octet_length(F.col(item_text).cast("string")))).first()[0] or 0
    todo = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter((F.length("text") > 2 * min_match - 2) & F.col("doc_id").isNotNull())
    own = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("item_text")).filter("item_id is not null and item_text is not null").distinct()
    if size > block_mb * 1e6:
        return _joined(todo, own, min_match).distinct()
    return _against(todo, sorted((r[0], r[1]) for r in own.collect()), min_match).distinct()


def _against(docs: DataFrame, items: list[tuple[int, str]], min_match: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(sent.value, min_match)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield _batch([(ids[d], *rest) for d, *rest in index.leaks(batch.column(1).to_pylist())])

    return docs.mapInArrow(run, SCHEMA)


def sampled_runs(text: str, min_match: int, known: dict[str, int]) -> np.ndarray:
    """Hashes, each once, of short runs of words, of which every run of ``min_match`` words holds at least one, wherever it stands.

    Of the runs of half as many words those are taken whose hash is the least among those that a run of ``min_match`` words holds.
    """
    short = max(1, min_match // 2)
    numbers = np.array([known.get(w) or known.setdefault(w, xxhash.xxh3_64_intdigest(w.encode())) for w in words(text)], np.uint64)
    if len(numbers) < min_match:
        return np.zeros(0, np.uint64)
    h = rolling.mix(rolling.polynomial(numbers, short))[: len(numbers) - short + 1]
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, min_match - short + 1).min(axis=1))


def _joined(docs: DataFrame, items: DataFrame, min_match: int) -> DataFrame:
    def sample(df: DataFrame, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, int] = {}
            for batch in batches:
                if len(known) > 1_000_000:
                    known.clear()
                found = [sampled_runs(t, min_match, known) for t in batch.column(1).to_pylist()]
                take = np.repeat(np.arange(len(found)), [len(x) for x in found])
                h = np.concatenate(found) if found else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), pa.array(h.view(np.int64))], [name, "h"])

        return df.mapInArrow(run, f"{name} binary, h long")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, known = [], {}
            for doc, text, item, item_text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                index = known.get((item, item_text)) or known.setdefault((item, item_text), Items([(item, item_text)], min_match))
                rows += [(doc, *rest) for _, *rest in index.leaks([text])]
            yield _batch(rows)

    d = docs.withColumn("d", F.unhex(F.md5(F.concat_ws("\0", "doc_id", "text"))))
    i = items.withColumn("i", F.unhex(F.md5(F.concat_ws("\0", "item_id", "item_text"))))
    met = cut_lineage(sample(d.select("d", "text"), "d").join(sample(i.select("i", "item_text"), "i"), "h").select("d", "i").distinct())
    pairs = met.join(d.distinct(), "d").join(i, "i").select("doc_id", "text", "item_id", "item_text")
    return pairs.mapInArrow(tile, SCHEMA)
