"""Cleaning of post markup and small text scalars, as chains of built-in column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from zbior.functions.dates import SPACE

# What is taken out of a post's markup, in order, with what takes its place.
DROP_QUOTES = [
    (r'(?s)<div class="quotewrapper">.*?</div>', ""),
    (r"(?is)<blockquote[^>]*>.*?</blockquote>", ""),
    (r'(?is)<div[^>]+class="[^"]*quote[^"]*"[^>]*>.*?</div>', ""),
]
DROP_NOTES = [
    (r'(?s)<span class="postbody signature">.*?</span>', ""),
    (r'(?is)<div class="notice">.*?</div>', ""),
    (rf"(?is)<span[^>]*>{SPACE}*<span[^>]*>{SPACE}*Dodano po.*?</span>{SPACE}*</span>", ""),
]
BARE_URLS = [(r'https?://[^\s\p{Z}<>"]+', ""), (r'www\.[^\s\p{Z}<>"]+', "")]
BLOCK_TAGS = [(rf"(?i)<br{SPACE}*/?>", "\n"), (r"</div>", "\n"), (r"</span>", "\n"), (r"<div[^>]*>", ""), (r"<span[^>]*>", ""), (r"<[^>]+>", "")]
SQUEEZE = [(rf"\n{SPACE}*\n", "\n"), (rf"{SPACE}+", " ")]
CLEAN_POST = [
    *DROP_QUOTES, *DROP_NOTES, (r"<img[^>]*>", ""), (r"(?is)<a[^>]*>.*?</a>", ""), *BARE_URLS, (r"(?i)link z opisem on-line", ""),
    *BLOCK_TAGS, *SQUEEZE, (r"([a-z])([A-Z])", r"\1 \2"), (r"([A-Z])([0-9])", r"\1 \2"), (r"([0-9])([A-Z])", r"\1 \2"),
    ("ETYKAtom", "ETYKA tom"), ("SPIS TREŚCIOd", "SPIS TREŚCI Od"), (rf"{SPACE}+", " "), (rf"(?i)Dodano po{SPACE}+[^:]+:", ""),
]
CLEAN_POST_KEEPING_LINKS = [
    (r"(?s)<blockquote[^>]*>.*?</blockquote>", ""), (r'(?s)<div id="sig[^"]*" class="signature">.*?</div>', ""), (r'(?s)<div class="notice">.*?</div>', ""),
    (r'(?s)<span class="biblia"[^>]*>.*$', ""), (r"<img[^>]*>", ""), (r"<a[^>]*>(.*?)</a>", r"\1"), *BARE_URLS, *BLOCK_TAGS, *SQUEEZE,
]
_QUOTE_DIVS = [
    (r'(?is)<div[^>]+class="[^"]*quote[^"]*"[^>]*>.*?</div>', ""),
    (r"(?is)<div[^>]+class='[^']*quote[^']*'[^>]*>.*?</div>", ""),
    (r"(?is)<div[^>]*class=[^>]*quote[^>]*>.*?</div>", ""),
    (r"(?is)<div[^>]*id=[^>]*quote[^>]*>.*?</div>", ""),
]
STRIP_QUOTES = [
    *DROP_QUOTES[1:2] * 2, DROP_NOTES[2], (rf"(?is)<span[^>]*>{SPACE}*Dodano po.*?</span>", ""), *_QUOTE_DIVS * 2,
    (r'(?is)<div[^>]*class="quotetitle"[^>]*>.*?</div>', ""), (r"(?is)<cite[^>]*>.*?</cite>", ""),
    (r'(?is)<table[^>]+class="[^"]*quote[^"]*"[^>]*>.*?</table>', ""),
]


def apply_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The rules one after the other; back references are written ``\\1``."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], re.sub(r"\\(\d)", r"$\1", r[1])), rules, text)


def rules_sql(column: str, rules: list[tuple[str, str]]) -> str:
    """The same chain as a SQL expression with regexp_replace(…, 'g')."""
    return reduce(lambda c, r: "regexp_replace({}, '{}', '{}', 'g')".format(c, r[0].replace("'", "''"), r[1].replace("'", "''")), rules, column)


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def clean_post(html: Column) -> Column:
    """A post's own words: quotes, signatures, notices, images, links with their text, and addresses go; null gives ''."""
    return strip(apply_rules(F.coalesce(html, F.lit("")), CLEAN_POST))


def clean_post_keeping_links(html: Column) -> Column:
    """As ``clean_post`` for boards whose link texts belong to the post; everything from a Bible box on goes."""
    return strip(apply_rules(F.coalesce(html, F.lit("")), CLEAN_POST_KEEPING_LINKS))


def strip_quotes(html: Column) -> Column:
    """Markup without quoted sections. Nested quotes close at the inner end tag, so an outer tail stays."""
    return apply_rules(F.coalesce(html, F.lit("")), STRIP_QUOTES)


def gender(text: Column) -> Column:
    """M or K from the words and letters in use, else null."""
    g = F.lower(strip(text))
    return F.when(g.isin("mężczyzna", "mezczyzna", "m"), "M").when(g.isin("kobieta", "k"), "K")


def counter(text: Column, label: str = "") -> Column:
    """The first number after ``label`` (such as ``Odpowiedzi:``) in ``text``, 0 if there is none."""
    pattern = (re.escape(label).replace(r"\ ", " ") + rf"{SPACE}*" if label else "") + r"(\d+)"
    return F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("long"), F.lit(0).cast("long"))


def post_number(url: Column) -> Column:
    """The number behind ``p=`` in a post's link, null if there is none."""
    return F.regexp_extract(url, r"p=(\d+)", 1).try_cast("long")


def entity_kind(label: Column) -> Column:
    """person, org, gpe, event or other from the labels that annotators use."""
    return F.when(label.isin("PERSON", "PER"), "person").when(label.isin("ORG", "ORGANIZATION"), "org").when(label.isin("GPE", "LOC", "LOCATION"), "gpe").when(label == "EVENT", "event").otherwise("other")
