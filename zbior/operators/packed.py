"""Several values packed in one text, split by a small parsing expression grammar.

    packed  <- list / item (sep item)*
    item    <- quoted &(sep / end) / list &(sep / end) / bare
    list    <- '[' (element (',' element)*)? ']'
    element <- quoted &(',' / ']') / bare without ',' and ']'
    quoted  <- '"' ... '"' / "'" ... "'" / '„' ... '”'      (doubled quotes and backslashes are escapes)
    bare    <- anything up to a separator

Alternatives are tried in this order; where a quote or bracket does not close before a separator, the
parser goes back and takes the text as bare, without the stray mark and with an error flag.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = re.compile(r"\s*")
_QUOTED = {
    '"': re.compile(r'"((?:[^"\\]|\\.|"")*)"', re.S),
    "'": re.compile(r"'((?:[^'\\]|\\.|'')*)'", re.S),
    "„": re.compile(r"„([^”\"]*)[”\"]", re.S),
}
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\(.)", re.S)
_SURROGATES = re.compile("[\ud800-\udbff][\udc00-\udfff]")
# Letters after a backslash that stand for a control character.
_CONTROL = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}

# What separates values, by kind of field.
SEPARATORS = {
    "names": r"[;,|/&•·\n\r\t]|(?<=\s)(?:i|oraz)(?=\s)",
    "tags": r"[;,|/•·\n\r\t]",
    "urls": r"[\s;,|•·]+(?=$|[\s;,|•·\"'„\[]|https?://|www\.)",
}


def _unescape(text: str, quote: str) -> str:
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _CONTROL.get(m[3], m[3]), text)
        text = _SURROGATES.sub(lambda m: m[0].encode("utf-16", "surrogatepass").decode("utf-16"), text)
    return text.replace(quote * 2, quote) if quote in "\"'" else text


class Packed:
    """A parser for one kind of field; ``parse`` gives (value, malformed) in order, without empty values."""

    def __init__(self, kind: str) -> None:
        self.sep = re.compile(SEPARATORS[kind])
        self.bare = re.compile(rf"(?:(?!{SEPARATORS[kind]}).)+", re.S)
        self.element = re.compile(r"[^,\]]+", re.S)
        self.comma = re.compile(r"[,\]]")

    def parse(self, text: str | None) -> list[tuple[str, bool]]:
        if not text or text.isspace():
            return []
        at = _SPACE.match(text).end()
        whole = self._list(text, at, None)
        if whole is not None:
            values, at = whole
        else:
            values, at = [], 0
            while at < len(text):
                at, found = self._item(text, at)
                values += found
                gap = self.sep.match(text, at)
                at = gap.end() if gap and gap.end() > at else at + (not found and at < len(text))
        clean = [(_tidy(v), bad) for v, bad in values]
        return [(v, bad) for v, bad in clean if v]

    def _item(self, text: str, at: int) -> tuple[int, list[tuple[str, bool]]]:
        at = _SPACE.match(text, at).end() if not self.sep.match(text, at) else at
        if (quoted := self._quoted(text, at, self.sep)) is not None:
            return quoted[1], [(quoted[0], False)]
        if (inner := self._list(text, at, self.sep)) is not None:
            return inner[1], inner[0]
        bare = self.bare.match(text, at)
        if not bare:
            return at, []
        value = bare[0].strip()
        trimmed = value.strip("\"„”[]") if value[:1] in "\"„[" or value[-1:] in "\"”]" else value
        return bare.end(), [(trimmed, trimmed != value)]

    def _quoted(self, text: str, at: int, after: re.Pattern) -> tuple[str, int] | None:
        """The value of a quoted text that ends at a separator, and where it ends; None to try another alternative."""
        mark = text[at : at + 1]
        hit = _QUOTED[mark].match(text, at) if mark in _QUOTED else None
        if not hit:
            return None
        end = _SPACE.match(text, hit.end()).end()
        if end < len(text) and not after.match(text, end) and not after.match(text, hit.end()):
            return None
        return _unescape(hit[1], mark), hit.end()

    def _list(self, text: str, at: int, after: re.Pattern | None) -> tuple[list[tuple[str, bool]], int] | None:
        """The values of a bracketed list that closes before a separator or the end; None to try another alternative."""
        if text[at : at + 1] != "[":
            return None
        values, at = [], at + 1
        while True:
            at = _SPACE.match(text, at).end()
            if text[at : at + 1] == "]":
                at += 1
                break
            if text[at : at + 1] == ",":
                at += 1
                continue
            quoted = self._quoted(text, at, self.comma)
            if quoted is not None:
                values.append((quoted[0], False))
                at = quoted[1]
            elif text[at : at + 1] in _QUOTED or not (bare := self.element.match(text, at)):
                return None
            else:
                values.append((bare[0], False))
                at = bare.end()
        end = _SPACE.match(text, at).end()
        return (values, end) if end == len(text) or after is not None and after.match(text, at) else None


def _tidy(value: str) -> str:
    return value.strip().strip("​﻿").strip()


def split_packed(df: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """``rec_id`` (text of ``key``), ``pos`` (long, from 0), ``val`` and ``malformed`` of each value in ``text``.

    ``kind`` is one of ``SEPARATORS``. Null, empty, blank and ``[]`` texts give no row; empty values
    neither count nor take a position; a repeated row gives its rows again. A null key is kept as null.
    Each text is parsed whole, in its own task; nothing is shuffled.
    """
    todo = df.select(F.col(key).cast("string").alias("rec_id"), F.col(text).cast("string").alias("val")).filter(F.length(F.regexp_replace("val", r"[\[\]\s]", "")) > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = Packed(kind).parse
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for rec, value in zip(ids, batch.column(1).to_pylist(), strict=True):
                out += [(rec, pos, v, bad) for pos, (v, bad) in enumerate(parse(value))]
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.bool_()), strict=True)], ["rec_id", "pos", "val", "malformed"])

    return todo.mapInArrow(run, "rec_id string, pos long, val string, malformed boolean")
