"""Long exact spans shared between records, by content-defined chunking with a gear rolling hash.

A chunk ends where the hash of the ``WINDOW`` characters that end there is the least among its
neighbours, so that cuts follow the content and survive insertions; with neighbourhoods of
``span - WINDOW + 1`` places, every run of ``span`` characters holds at least one such cut together with
its whole window, wherever else the records differ. A chunk's digest is the hash of its closing window (of
more it may share less); contents that share a digest are compared exactly, run by run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zbior.llm import rolling
from zbior.session import cut_lineage

#: Characters under a chunk's digest: two gear windows of 64, the second 16 after the first.
WINDOW = 80
#: Most contents whose key is sent to every executor to pick out their texts; beyond it, keys are shuffled.
BROADCAST_KEYS = 2_000_000
#: Contents with one digest from which it is replaced by finer ones, and most digests for which that is done (the
#: most frequent); the result is the same without.
HOT, MAX_HOT = 50, 500_000
#: Bits of the bitmap of digests that recur, 32 MB whatever their number; where it fills up, more digests pass that do not recur.
BITS = 28


def cut_points(texts: list[str], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, character before which the chunk ends, digest) of every cut."""
    points, starts = rolling.code_points(texts)
    n, reach = len(points), span - WINDOW + 1
    if n < span:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    h = rolling.gear(points, 64)
    late = WINDOW - 64
    digest = h.copy()
    with np.errstate(over="ignore"):
        digest[late:] = rolling.mix(h[late:] + rolling.mix(h[:-late]))
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    ahead, behind = starts[1:][owner] - np.arange(n), np.arange(n) - starts[:-1][owner]
    full = behind >= WINDOW - 1
    value = np.where(full, digest, np.uint64(0xFFFFFFFFFFFFFFFF))
    least = rolling.sliding(value, reach, least=True, ahead=True)
    least[~(full & (ahead >= reach))] = 0
    cut = full & (rolling.sliding(least, reach, least=False, ahead=False) == value)
    at = np.flatnonzero(cut)
    return owner[at], behind[at] + 1, digest[at]


def _finer(texts: list[str], owner: np.ndarray, pos: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(index of the text, two hashes, offset) of all runs of ``span`` characters that hold the window of one of the cuts."""
    points, starts = rolling.code_points(texts)
    first = starts[owner] + np.maximum(pos - span, 0)
    last = np.minimum(starts[owner] + pos - WINDOW, starts[owner + 1] - span)
    edges = np.zeros(len(points) + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, last + 1, -1)
    at = np.flatnonzero(np.cumsum(edges)[:-1] > 0)
    text = np.searchsorted(starts, at, "right") - 1
    return text, rolling.mix(rolling.polynomial(points, span)[at]), rolling.mix(rolling.polynomial(rolling.mix(points.astype(np.uint64)), span)[at]), at - starts[text]


DIGESTS = "h long, g long, k binary, spans array<struct<s:int,e:int>>"
_SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def recurring(digests: DataFrame) -> np.ndarray:
    """A bitmap by the first ``BITS`` bits of each ``h`` of ``digests``, built in 64 slices of equal size."""
    high = 6

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            h = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            part = (h >> np.uint64(64 - high)).astype(np.int64)
            for k in np.unique(part).tolist():
                bits = own.setdefault(k, np.zeros(1 << (BITS - high), bool))
                bits[((h[part == k] << np.uint64(high)) >> np.uint64(64 - BITS + high)).astype(np.int64)] = True
        for k, bits in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["part", "bits"])

    sliced = digests.select(F.shiftrightunsigned("h", 64 - high).cast("int").alias("part"), "h").repartition(1 << high, "part")
    out = np.zeros((1 << high, 1 << (BITS - high - 3)), np.uint8)
    for r in sliced.mapInArrow(fill, "part int, bits binary").collect():  # 64 slices, of fixed size in all
        out[r["part"]] |= np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _in_bitmap(bitmap: np.ndarray, digests: np.ndarray) -> np.ndarray:
    at = (digests >> np.uint64(64 - BITS)).astype(np.int64)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def chunk_digests(records: DataFrame, span: int, hot: list[int] = (), bitmap: np.ndarray | None = None) -> DataFrame:
    """``h`` (digest) and ``k`` of every chunk of ``records`` (k, content), each pair once for each batch.

    For a digest in ``hot``, in its place all runs of ``span`` characters around its window, with two hashes
    ``h`` and ``g`` and the parts of the content that they cover, so that contents meet that share a whole run, and
    are known to without being compared. A rule of thousands of dashes has one digest and one run, whatever
    its length. Copies of one content within a batch count once, so that a content that is copied a million
    times leaves its batches as a few rows. With ``bitmap`` (from ``recurring``) digests that are not in it are left out.
    """
    sent = records.sparkSession.sparkContext.broadcast((np.array(sorted(hot), np.int64).view(np.uint64), bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, bitmap = sent.value
        for batch in batches:
            by = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            keys, texts = pa.array(list(by), pa.binary()), list(by.values())
            for low in range(0, len(texts), 2000):
                own = texts[low : low + 2000]
                owner, pos, digest = cut_points(own, span)
                if bitmap is not None:
                    again = _in_bitmap(bitmap, digest)
                    owner, pos, digest = owner[again], pos[again], digest[again]
                finer = np.isin(digest, often)
                coarse = np.unique(np.stack([owner[~finer].astype(np.uint64), digest[~finer]]), axis=1)
                h, g, k, covered = coarse[1].view(np.int64), [None] * coarse.shape[1], coarse[0].astype(np.int64), [None] * coarse.shape[1]
                if finer.any():
                    text, h1, h2, at = _finer(own, owner[finer], pos[finer], span)
                    order = np.lexsort((at, h2, h1, text))
                    text, h1, h2, at = (x[order] for x in (text, h1, h2, at))
                    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
                    h, k = np.concatenate([h, h1[first].view(np.int64)]), np.concatenate([k, text[first]])
                    g += h2[first].view(np.int64).tolist()
                    covered += [_intervals(x, span) for x in np.split(at, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g, pa.int64()), keys.take(pa.array(low + k)), pa.array(covered, _SPANS)], ["h", "g", "k", "spans"])

    return records.mapInArrow(run, DIGESTS)


def _intervals(starts: np.ndarray, span: int) -> list[dict]:
    """The union of the runs of ``span`` characters at ``starts`` (ascending), as offsets from and to."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > span)
    return [{"s": int(s), "e": int(e) + span} for s, e in zip(starts[np.concatenate([[0], gap + 1])], starts[np.concatenate([gap, [-1]])], strict=True)]


class _Hashes:
    """A content and the hashes of its runs of ``span`` characters."""

    def __init__(self, text: str, span: int) -> None:
        self.text, self.span = text, span
        self.hashes = rolling.polynomial(rolling.code_points([text])[0], span)[: len(text) - span + 1]
        self.sorted = np.sort(self.hashes)

    def meets(self, other: "_Hashes") -> bool:
        """Whether any run occurs in both; equal hashes are compared character by character."""
        at = np.minimum(np.searchsorted(other.sorted, self.hashes), len(other.sorted) - 1)
        for i in np.flatnonzero(other.sorted[at] == self.hashes).tolist():
            j = int(np.flatnonzero(other.hashes == self.hashes[i])[0])
            if self.text[i : i + self.span] == other.text[j : j + self.span]:
                return True
        return False


class _Runs:
    """A content's code points and the distinct hashes of its runs of ``span`` characters, in order."""

    def __init__(self, text: str, span: int) -> None:
        self.points, self.span = rolling.code_points([text])[0], span
        self.hashes, self.first, self.which = np.unique(rolling.polynomial(self.points, span)[: len(self.points) - span + 1], return_index=True, return_inverse=True)

    def shared(self, other: "_Runs") -> tuple[np.ndarray, np.ndarray]:
        """Where in each of two contents runs begin that the other has as well; equal hashes are compared character by character."""
        _, mine, theirs = np.intersect1d(self.hashes, other.hashes, assume_unique=True, return_indices=True)
        same = [i for i, (a, b) in enumerate(zip(self.first[mine].tolist(), other.first[theirs].tolist(), strict=True)) if (self.points[a : a + self.span] == other.points[b : b + self.span]).all()]
        return np.flatnonzero(np.isin(self.which, mine[same])), np.flatnonzero(np.isin(other.which, theirs[same]))


def _verify(pairs: DataFrame, span: int, places: bool) -> DataFrame:
    """Those of ``pairs`` (ka, kb, ta, tb) that share a run; with ``places``, where."""
    make = _Runs if places else _Hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, own, theirs, known = [], [], [], {}
            for i, (ka, kb, ta, tb) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if len(known) > 1000:
                    known.clear()
                a, b = known.get(ka) or known.setdefault(ka, make(ta, span)), known.get(kb) or known.setdefault(kb, make(tb, span))
                if not places:
                    if a.meets(b):
                        kept.append(i)
                    continue
                at_a, at_b = a.shared(b)
                if len(at_a):
                    kept.append(i)
                    own.append(_intervals(at_a, span))
                    theirs.append(_intervals(at_b, span))
            take = pa.array(kept, pa.int64())
            spans = (own, theirs) if places else ([None] * len(kept),) * 2
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x, _SPANS) for x in spans)], ["ka", "kb", "spans_a", "spans_b"])

    return pairs.mapInArrow(run, "ka binary, kb binary, spans_a array<struct<s:int,e:int>>, spans_b array<struct<s:int,e:int>>")


def _few(keys: DataFrame) -> DataFrame:
    """``keys``, marked to be sent to every executor if they have been counted to be few enough."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def keyed(df: DataFrame, key: str, text: str, span: int = 120) -> DataFrame:
    """``id`` (text), ``content`` and ``k`` (its 128-bit digest) of the rows that can share a span; others (null, short) are left out."""
    records = df.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("content")).filter((F.length("content") >= span) & F.col("id").isNotNull())
    return records.withColumn("k", F.unhex(F.md5("content")))


def linked_contents(records: DataFrame, span: int = 120, places: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Of ``records`` (from ``keyed``) every two different contents that share ``span`` or more identical characters, and the rest of what they share.

    The first frame has ``ka`` < ``kb`` and ``spans_a`` and ``spans_b``, what they share (from ``s`` to ``e``), null where all of it is in the
    second frame and without ``places``: ``k`` and ``spans`` of runs around hot digests that several contents have (None if there are no hot digests).

    Only contents that share a digest meet, in a join whose skew the engine splits, never in a group held
    by one task. A digest that very many contents share (a line longer than the window but shorter than
    ``span``, say) gives way to whole runs, so that it makes no more pairs than there are links. The texts are
    hashed twice, the second time for the digests that recur, since keeping the digests until it is known which of them are hot would gather a hot one's rows.
    """
    if span <= WINDOW:
        raise ValueError(f"span must exceed {WINDOW}")
    contents = records.select("k", "content")
    counted = cut_lineage(chunk_digests(contents, span).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    hot = [r["h"] for r in counted.filter(F.col("n") > HOT).orderBy(F.desc("n"), "h").limit(MAX_HOT).collect()]
    digests = chunk_digests(contents, span, hot, recurring(counted))
    each = digests.select("h", "g", "k").distinct()
    a, b = (each.select("h", F.col("g").alias(f"g{x}"), F.col("k").alias(f"k{x}")) for x in "ab")
    met = a.join(b, "h").filter("ka < kb and ga <=> gb").groupBy("ka", "kb").agg(F.bool_or(F.col("ga").isNull()).alias("unsure"))
    met = cut_lineage(met)
    unsure = met.filter("unsure").select("ka", "kb")
    wanted = _few(unsure.select(F.col("ka").alias("k")).union(unsure.select(F.col("kb").alias("k"))).distinct())
    texts = records.join(wanted, "k", "left_semi").groupBy("k").agg(F.first("content").alias("content"))
    side = lambda x: texts.select(F.col("k").alias(f"k{x}"), F.col("content").alias(f"t{x}"))
    links = _verify(unsure.join(side("a"), "ka").join(side("b"), "kb").select("ka", "kb", "ta", "tb"), span, places)
    links = links.unionByName(met.filter("not unsure").select("ka", "kb"), allowMissingColumns=True)
    if not (hot and places):
        return links, None
    whole = digests.filter("g is not null")
    several = whole.groupBy("h", "g").agg(F.min("k").alias("low"), F.max("k").alias("high")).filter("low < high").select("h", "g")
    return links, whole.join(several, ["h", "g"], "left_semi").select("k", "spans")


def _copied(records: DataFrame) -> DataFrame:
    """``k`` of every content that several ids have."""
    return cut_lineage(records.groupBy("k").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("k"))


def shared_pairs(df: DataFrame, key: str, text: str, span: int = 120) -> DataFrame:
    """``id_a`` < ``id_b`` (text) of every two records that share ``span`` or more identical characters.

    Null, blank and short texts share nothing; a record repeated with the same key and text counts once;
    with one key and several texts, each text counts. Pairs are the result itself: contents are compared
    once, and only at the end joined to the ids that have them.
    """
    records = keyed(df, key, text, span)
    links = cut_lineage(linked_contents(records, span, places=False)[0].select("ka", "kb"))
    members = records.select("k", "id")
    ends = _few(links.select(F.col("ka").alias("k")).union(links.select(F.col("kb").alias("k"))).distinct())
    own = members.join(ends, "k", "left_semi").distinct()
    x, y = own.select(F.col("k").alias("ka"), F.col("id").alias("x")), own.select(F.col("k").alias("kb"), F.col("id").alias("y"))
    different = links.join(x, "ka").join(y, "kb").filter("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    copies = members.join(_few(_copied(records)), "k", "left_semi").distinct()
    same = copies.withColumnRenamed("id", "id_a").join(copies.withColumnRenamed("id", "id_b"), "k").filter("id_a < id_b").select("id_a", "id_b")
    return different.unionByName(same).distinct()


def shared_characters(df: DataFrame, key: str, text: str, span: int = 120) -> DataFrame:
    """For every record that shares spans: ``id``, ``class_id`` (least id with the same content), ``n_copies`` (other ids with it),
    ``n_links`` (other contents that share a span with it) and ``shared_chars`` (characters inside any shared span, each once).

    Contents are compared, not records, so a content that very many records have costs a row for each of them.
    Of an id with several contents each comes out. Null, blank and short texts and texts that share nothing do not.
    """
    records = keyed(df, key, text, span)
    links, around = linked_contents(records, span)
    links = cut_lineage(links)
    sides = links.select(F.col("ka").alias("k"), F.col("spans_a").alias("iv")).unionByName(links.select(F.col("kb").alias("k"), F.col("spans_b").alias("iv")))
    union = F.aggregate(
        F.sort_array("ivs"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("e")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(x["e"] - F.greatest(acc["e"], x["s"]), F.lit(0))).alias("n"), F.greatest(acc["e"], x["e"]).alias("e")),
    )["n"]
    n_links = sides.groupBy("k").agg(F.count("*").alias("n_links"))
    parts = sides.unionByName(around.select("k", F.col("spans").alias("iv"))) if around else sides
    covered = parts.select("k", F.explode("iv").alias("iv")).distinct().groupBy("k").agg(F.collect_list("iv").alias("ivs")).select("k", union.cast("long").alias("covered"))
    linked = cut_lineage(n_links.join(covered, "k"))
    wanted = _few(linked.select("k").union(_copied(records)).distinct())
    own = cut_lineage(records.join(wanted, "k", "left_semi").select("k", "id", F.length("content").cast("long").alias("n")).distinct())
    classes = own.groupBy("k").agg(F.min("id").alias("class_id"), (F.count("*") - 1).alias("n_copies"))
    joined = own.join(classes, "k").join(linked, "k", "left")
    return joined.select("id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("n_copies") > 0, F.col("n")).otherwise(F.col("covered")).alias("shared_chars"))
