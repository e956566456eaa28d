"""Abusive, hateful and sexual posts, by comparing how well two zstandard dictionaries compress them.

Both dictionaries come from labelled posts. Words and pairs of words that posts rated toxic have far more often
than chance allows mark the toxic passages; the ordinary dictionary is made of sentences without them, the toxic
one of the same sentences and of the toxic passages besides, so that what it saves is what only toxic text
explains. Every window of a post is compressed with both; a post's score is its greatest saving in bytes. The
threshold is calibrated on labelled posts that the dictionaries of that step have not seen.

Characters are written as 32-bit codes of letter triples before compression, so that a letter that no
dictionary knows is dear and a known passage cheap, whatever its length.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled posts that the dictionaries and the threshold are made from, and most others that widen the ordinary text.
MAX_LABELLED, MAX_OTHERS = 20_000, 4_000
#: Threshold in bytes where labels are too few to calibrate one, and how few that is.
THRESHOLD, MIN_TOXIC = 6, 300
#: Most words of a window, and words from the start of one to the start of the next.
WINDOW, STEP = 16, 8
#: Words (and pairs) that may be taken for toxic by chance.
BY_CHANCE = 2
#: Appended to every window, so that one of unknown words is not stored as it is, which would hide what a dictionary saves.
FILLER = bytes(96)
#: Characters that are written as codes at once.
BLOCK = 400_000

_MARKS = re.compile("[̀-ͯ]+")
_LEET = str.maketrans("013457", "oieast")
_MIXED = re.compile(r"(?<![^\W_])(?=\w*[^\W\d_])(?=\w*\d)\w+")
_SPACED_OUT = re.compile(r"(?<!\w)(?:\w[ .\-_*]){2,}\w(?!\w)")
_HIDDEN = re.compile(r"(?<=[a-z])[@#$*%](?=[a-z])|(?<![a-z])[@#$*%](?=[a-z]{2})")
_DOUBLED = re.compile(r"([a-z])\1+")
_BREAK = re.compile(r"[.!?…\n]+")
_WORD = re.compile(r"[a-z*]+")
_DIGIT, _MARK = re.compile(r"\d"), re.compile(r"[@#$*%]")

Sentence = list[str]


def sentences(text: str | None) -> list[Sentence]:
    """The words of each sentence: no case or diacritics, digits among letters read as letters, words spelt
    out put together, doubled letters once, a letter hidden by a sign as ``*``."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFD", text)).replace("ł", "l")
    if _DIGIT.search(text):
        text = _MIXED.sub(lambda m: m[0].translate(_LEET), text)
    if _SPACED_OUT.search(text):
        text = _SPACED_OUT.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), text)
    if _MARK.search(text):
        text = _HIDDEN.sub("*", text)
    return [w for s in _BREAK.split(_DOUBLED.sub(r"\1", text)) if (w := _WORD.findall(s))]


_CODES = np.random.default_rng(20).integers(0, 1 << 32, 1 << 15, dtype=np.uint64).astype(np.uint32)


def _wide(text: str) -> bytes:
    """The codes of all letter triples of ``text``, four bytes each."""
    raw = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    a = np.where(raw == 42, 30, raw & 31).astype(np.uint16)  # the asterisk apart from the letter j
    return _CODES[(a[:-2] << 10) + (a[1:-1] << 5) + a[2:]].tobytes() if len(a) > 2 else b""


def _compressor(phrases: list[str]) -> zstd.ZstdCompressor:
    content = _wide("".join(f" {p} " for p in phrases)) or bytes(8)
    size = max(18, len(content).bit_length())  # all of the dictionary is within the window and in the tree
    parameters = zstd.ZstdCompressionParameters(
        format=zstd.FORMAT_ZSTD1_MAGICLESS, window_log=size, hash_log=size - 2, chain_log=size + 1, search_log=4, min_match=4, target_length=999,
        strategy=zstd.STRATEGY_BTLAZY2, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    return zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=parameters)


@dataclass
class Model:
    """The two dictionaries' phrases, and the threshold in bytes."""

    ordinary: list[str]
    toxic: list[str]
    threshold: float = THRESHOLD

    @cached_property
    def compressors(self) -> tuple[zstd.ZstdCompressor, zstd.ZstdCompressor]:
        return _compressor(self.ordinary), _compressor(self.ordinary + self.toxic)  # what comes last is found best

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "compressors"}

    def scores(self, posts: list[list[Sentence]]) -> list[int]:
        """Most bytes that the toxic dictionary saves on any window of each post; 0 if it saves none."""
        out, begin, size = [], 0, 0
        for end, post in enumerate(posts, 1):
            size += sum(len(w) + 1 for s in post for w in s)
            if size >= BLOCK or end == len(posts):
                out += self._block(posts[begin:end])
                begin, size = end, 0
        return out

    def _block(self, posts: list[list[Sentence]]) -> list[int]:
        plain, toxic = (c.compress for c in self.compressors)
        codes, at, out = _wide("".join(f" {' '.join(s)} " for post in posts for s in post)), 0, []
        for post in posts:
            best = 0
            for s in post:
                if len(s) <= WINDOW:
                    length = sum(map(len, s)) + len(s) + 1
                    windows = (codes[4 * at : 4 * (at + length - 2)],)
                else:
                    places = [at]
                    for w in s:
                        places.append(places[-1] + len(w) + 1)
                    length = places[-1] - at + 1
                    windows = [codes[4 * places[i] : 4 * (places[min(i + WINDOW, len(s))] - 1)] for i in range(0, len(s) - WINDOW + STEP, STEP)]
                for w in windows:
                    w += FILLER
                    saved = len(plain(w)) - len(toxic(w))
                    if saved > best:
                        best = saved
                at += length
            out.append(best)
        return out

    def score(self, parts: list[Sentence]) -> int:
        return self.scores([parts])[0]


def _grams(s: Sentence) -> Iterator[tuple[int, int, str]]:
    """(first word, word after the last, text) of every word of two letters or more and every pair of words."""
    for i, w in enumerate(s):
        if len(w) > 1:
            yield i, i + 1, w
        if i + 1 < len(s):
            yield i, i + 2, f"{w} {s[i + 1]}"


def telling(posts: list[tuple[list[Sentence], float]]) -> set[str]:
    """Words and pairs of words that posts rated toxic have more often than chance allows, and mostly they.

    By Chernoff's bound on how likely so many of a word's posts are rated toxic when its posts are rated as all
    are; of all words (and of all pairs) that are in several posts, about ``BY_CHANCE`` may pass by chance.
    """
    every, bad = Counter(), Counter()
    for parts, share in posts:
        own = {g for s in parts for _, _, g in _grams(s)}
        every.update(own)
        if share > 0.5:
            bad.update(own)
    base = sum(share > 0.5 for _, share in posts) / max(1, len(posts))
    several = Counter(" " in g for g, n in every.items() if n > 1)
    out = set()
    for g, k in bad.items():
        rate = k / every[g]
        if k > 1 and rate >= 0.5 and rate > base:
            distance = rate * math.log(rate / base) + ((1 - rate) * math.log((1 - rate) / (1 - base)) if rate < 1 else 0)
            if every[g] * distance >= math.log(max(1, several[" " in g]) / BY_CHANCE):
                out.add(g)
    return out


def _hidden_forms(word: str) -> list[str]:
    return [word[:k] + "*" + word[k + 1 :] for k in range(len(word))]


def _shuffled(parts: list[Sentence]) -> list[Sentence]:
    return sorted(parts, key=lambda s: hashlib.blake2b(" ".join(s).encode(), digest_size=8).digest())


def _build(posts: list[tuple[list[Sentence], float]], others: list[list[Sentence]]) -> Model:
    """Toxic: what reaches from the first telling word to the last in sentences of posts rated toxic, and the telling words
    among it with a letter hidden. Ordinary: of sentences without telling words, as raters err, those with a word not met
    before or a pair not met before with a word of the toxic passages."""
    told = telling(posts)
    found: dict[str, None] = {}
    for parts, share in posts:
        if share > 0.5:
            for s in parts:
                marks = [(a, e) for a, e, g in _grams(s) if g in told]
                if marks:
                    found[" ".join(s[min(a for a, _ in marks) : max(e for _, e in marks)])] = None
    words = {w for p in found for w in p.split()}
    alone = sorted(w for w in words & told if "*" not in w)
    toxic = sorted(h for w in alone for h in _hidden_forms(w)) + alone + list(found)
    words.update(w for p in toxic for w in p.split())
    ordinary, known, pairs = [], set(), set()
    for s in _shuffled([s for parts, share in posts if share == 0 for s in parts] + [s for parts in others for s in parts]):
        new = {p for p in zip(["", *s], s) if p not in pairs and not words.isdisjoint(p)}
        if (new or not known.issuperset(s)) and not any(g in told for _, _, g in _grams(s)):
            pairs |= new
            known.update(s)
            ordinary.append(" ".join(s))
    return Model(ordinary, toxic)


def train(labelled: list[tuple[str | None, float]], unlabelled: list[str | None] = ()) -> Model:
    """A model from (content, share of raters who call it toxic) and other contents, mostly harmless.

    Order does not matter, both may be empty. Without posts rated toxic there are no toxic passages and every score is 0.
    """
    posts = [(sentences(t), share) for t, share in sorted(labelled, key=lambda x: (x[0] or "", x[1])) if t]
    others = [sentences(t) for t in sorted(t for t in unlabelled if t)]
    model = _build(posts, others)
    if sum(share > 0.5 for _, share in posts) >= MIN_TOXIC:
        scores = []
        for k in (0, 1):
            tried = [(parts, share > 0.5) for parts, share in posts[1 - k :: 2] if share != 0.5]
            scores += zip(_build(posts[k::2], others).scores([parts for parts, _ in tried]), (bad for _, bad in tried), strict=True)
        total = sum(bad for _, bad in scores)

        def quality(t: int) -> float:
            hit, said = sum(bad for s, bad in scores if s >= t), sum(s >= t for s, _ in scores)
            return 2 * hit / (said + total)

        model.threshold = max(range(3, 24), key=lambda t: (round(quality(t), 3), -abs(t - THRESHOLD)))
    return model


_ALL = (1 << 63) - 1


def _some(df: DataFrame, key: str, most: int, total: int):
    """Whether a row's ``key`` has one of the smallest hashes, such that about ``most`` of ``total`` keys have; the key alone decides."""
    return F.xxhash64(key).bitwiseAND(F.lit(_ALL)) <= F.lit(min(_ALL, _ALL * most // max(1, total)))


def fit(posts: DataFrame, labels: DataFrame, key: str, text: str, labelled: int = MAX_LABELLED, others: int = MAX_OTHERS) -> Model:
    """``train`` on the contents of about ``labelled`` labelled posts and ``others`` posts at most.

    Only this sample reaches the driver, in one pass over the texts. Labels that are null or of unknown posts count for
    nothing; of a post with several texts the least one counts.
    """
    mean = labels.filter(F.col("toxic").isNotNull() & F.col("post_id").isNotNull()).groupBy("post_id").agg(F.avg("toxic").alias("share"))
    sample = mean.filter(_some(mean, "post_id", labelled, mean.count()))
    contents = posts.select(F.col(key).alias("post_id"), F.col(text).alias("content")).filter("post_id is not null and content is not null")
    other = _some(contents, "post_id", others, posts.count())
    found = contents.join(F.broadcast(sample), "post_id", "left").withColumn("other", other).filter("share is not null or other")
    rows = found.groupBy("post_id").agg(F.min("content").alias("content"), F.min("share").alias("share"), F.first("other").alias("other")).collect()
    return train([(r["content"], r["share"]) for r in rows if r["share"] is not None], [r["content"] for r in rows if r["other"]])


def score_posts(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """``key``, ``score`` (bytes, long) and ``toxic`` of every row; null, empty and blank texts score 0.

    Row by row: repeated rows come out again, a null key is kept, an empty table gives no row.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            scores = own.scores([sentences(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.int64()), pa.array([s >= own.threshold for s in scores], pa.bool_())], [key, "score", "toxic"])

    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, score long, toxic boolean")
