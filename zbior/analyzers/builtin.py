"""The analyzers that come with the engine."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zbior.functions import tokens as tk
from zbior.functions import urls as ur

#: Most characters of a text that the annotator reads by default; None reads all.
MAX_LENGTH = None


def _content(df: DataFrame) -> Column:
    """``content``, else ``text``; '' if there is neither."""
    own = [F.col(c) for c in ("content", "text") if c in df.columns]
    return F.coalesce(*own, F.lit(""))


class TokenCount:
    """Tokens by a byte-level BPE whose ranks are in the tiktoken file ``vocabulary``; 0 for blank texts."""

    name = "token_count"

    def __init__(self, vocabulary: str | None = None, **_: Any) -> None:
        self.vocabulary = vocabulary

    def apply(self, df: DataFrame) -> DataFrame:
        path = self.vocabulary

        @F.pandas_udf("long")
        def count(parts: pd.Series) -> pd.Series:
            encode = _encoder(path)
            return parts.map(lambda t: len(encode(t.strip())) if t and t.strip() else 0)

        return df.withColumn(self.name, F.struct(count(_content(df)).alias("token_count")))


_ENCODERS: dict = {}


def _encoder(path: str | None):
    if path not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _ENCODERS[path]


def _token(t: Column, low: Column) -> Column:
    """A token with word class, tag, relation and features, by rules; signs are punctuation."""
    sign = ~t.rlike(rf"^{tk.WORD}$")
    pos = F.when(sign, "PUNCT").otherwise(tk.word_class(low))
    tag = F.concat_ws(":", F.lower(pos), F.lower(F.get_json_object(tk.morphology(low), "$.Case")), F.lower(F.get_json_object(tk.morphology(low), "$.Gender")))
    dep = F.when(sign, "punct").when(pos == "ADJ", "amod").when(pos == "ADP", "case").when(pos == "CCONJ", "cc").when(pos == "ADV", "advmod").when(pos == "VERB", "ROOT").when(pos == "NUM", "nummod").otherwise("dep")
    features = F.from_json(F.when(~sign, tk.morphology(low)), "map<string,string>")
    return F.struct(
        t.alias("token"), low.alias("lemma"), pos.alias("pos"), F.when(sign, "interp").otherwise(tag).alias("tag"), dep.alias("dep"), features.alias("morph_features"),
        t.rlike(r"^\p{L}+$").alias("is_alpha"), low.isin(tk.STOP).alias("is_stop"), sign.alias("is_punct"),
    )


class BasicTokenizer:
    """Words and their statistics."""

    name = "basic_tokenizer"

    def __init__(self, lowercase: bool = True, min_token_length: int = 2, **_: Any) -> None:
        self.lower, self.least = lowercase, min_token_length

    def apply(self, df: DataFrame) -> DataFrame:
        words = tk.tokens(_content(df), self.lower, self.least)
        return df.withColumn(self.name, F.struct(words.alias("tokens"), tk.token_stats(words).alias("token_stats")))


class RuleAnnotator:
    """Words with word class and features, entities, sentence statistics and sentiment, by rules.

    It stands where a trained language model can be registered under the same name; its results are rules,
    not a model's.
    """

    name = "spacy_analyzer"

    def __init__(self, include_sentiment: bool = False, max_length: int | None = MAX_LENGTH, **_: Any) -> None:
        self.sentiment, self.max_length = include_sentiment, max_length

    def apply(self, df: DataFrame) -> DataFrame:
        text = _content(df) if self.max_length is None else F.substring(_content(df), 1, self.max_length)
        words = tk.tokens(text)
        n, sentences, chars = F.size(words).cast("long"), tk.sentence_count(text), F.length(text).cast("long")
        pieces = F.regexp_extract_all(text, F.lit(rf"{tk.WORD}|[^\p{{L}}\p{{N}}_\s]"), F.lit(0))  # words and single signs
        annotated = F.transform(pieces, lambda t: _token(t, F.lower(t)))
        entities = F.concat(*[tk.found_at(text, p, k) for k, p in tk.ENTITIES.items()])
        mood = tk.sentiment(words)
        polarity, subjectivity = (mood["polarity"], mood["subjectivity"]) if self.sentiment else (F.lit(None).cast("double"), F.lit(None).cast("double"))
        stats = F.struct(
            sentences.alias("sentence_count"), n.alias("word_count"), chars.alias("char_count"), F.when(sentences > 0, n / sentences).otherwise(F.lit(0.0)).alias("avg_sentence_length"),
            tk.readability(n, sentences, chars).alias("readability_score"), polarity.alias("sentiment_polarity"), subjectivity.alias("sentiment_subjectivity"), F.lit("pl").alias("language_detected"),
        )
        return df.withColumn(self.name, F.struct(annotated.alias("tokens"), entities.alias("entities"), stats.alias("linguistic_stats")))


def _urls(df: DataFrame) -> Column:
    return F.col("content_urls") if "content_urls" in df.columns else F.array().cast("array<string>")


def _categories(each: Column) -> Column:
    """A map of each distinct domain to its category and trust."""
    known = F.array_distinct(F.transform(F.filter(each, lambda u: u["domain"].isNotNull()), lambda u: F.struct(u["domain"].alias("key"), F.struct(u["category"].alias("category"), u["trust_score"].alias("trust_score")).alias("value"))))
    return F.map_from_entries(known)


class UrlAnalyzer:
    """Each address with domain, category, trust and type, and statistics by category."""

    name = "url_analyzer"

    def __init__(self, max_urls: int = ur.MAX_URLS, **_: Any) -> None:
        self.most = max_urls

    def apply(self, df: DataFrame) -> DataFrame:
        capped = F.filter(F.slice(F.coalesce(_urls(df), F.array().cast("array<string>")), 1, self.most), lambda u: u.isNotNull() & (F.trim(u) != ""))
        each = F.transform(capped, lambda u: F.struct(u.alias("url"), ur.domain(u).alias("domain"), ur.domain_category(ur.domain(u)).alias("category"), ur.trust_score(ur.domain_category(ur.domain(u))).alias("trust_score"), ur.url_type(u).alias("url_type"), F.lit(True).alias("is_external")))
        return df.withColumn(self.name, F.struct(each.alias("urls"), _categories(each).alias("domain_categories"), ur.url_stats(_urls(df), None, self.most).alias("url_stats")))


class DomainStats:
    """Number of addresses and their distinct domains."""

    name = "domain_stats"

    def __init__(self, **_: Any) -> None:
        pass

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.name, ur.light_domain_stats(_urls(df)))


BUILTIN = {c.name: c for c in (TokenCount, BasicTokenizer, RuleAnnotator, UrlAnalyzer, DomainStats)}
