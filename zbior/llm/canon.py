"""Freely typed values mapped to the entries of a reference list, by a prefix-filtered set-similarity join.

A value and every form of an entry become multisets of letters and letter pairs. Tokens are ordered by
how rare they are in all values and forms; two sets that are similar enough share several of their rarest
tokens, so only those are compared that do, with filters on the sets' sizes and the tokens' positions. Jaccard
similarity is then computed exactly; the best entry wins, a tie goes to fewer edits, then to the lower id.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zbior.functions.dates import SPACE

#: Least Jaccard similarity of letters and letter pairs at which a value means an entry.
THRESHOLD = 0.52
#: Rare tokens that two sets must share to be compared: prefixes are longer by as many, less one, which loses no pair.
SHARED = 8
#: Most distinct tokens, and most forms of entries, that are sent to every executor.
MAX_TOKENS, MAX_FORMS = 200_000, 50_000

# Words around a value that do not belong to it.
BEFORE = "gm gmina okolice k kolo miasto m parafia par diecezja archidiecezja obecnie teraz pl woj wies wyznanie raczej".split()
AFTER = "polska wies kraj praktykuje i okolice pl".split()
# Words of place names with the way they are shortened.
SHORT = {"wielkie": "wlk", "gorne": "grn", "dolne": "dln", "stare": "st", "nowe": "nw", "male": "ml", "lesne": "les", "nad": "n"}

# Letters whose UTF-8 bytes were read as Latin-1, by rule for every letter that Polish adds.
_MOJIBAKE = {c.encode().decode("latin-1"): c for c in "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ"}
_BROKEN = re.compile("|".join(map(re.escape, _MOJIBAKE)))
_ZERO = re.compile(r"(?<=[^\W\d_])0|0(?=[^\W\d_])")
_LETTERS = re.compile(r"[^\W\d_]+")


def plain_words(text: str) -> list[str]:
    """Lower-case words without diacritics; entities and mis-decoded letters restored, a zero among letters read as o."""
    text = _BROKEN.sub(lambda m: _MOJIBAKE[m[0]], html.unescape(text)).lower()
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).replace("ł", "l")
    return _LETTERS.findall(_ZERO.sub("o", text))


def compact(text: str) -> str:
    """The letters that tell which entry is meant, without the words around them and without spaces."""
    words = plain_words(text)
    while len(words) > 1 and words[0] in BEFORE:
        words = words[1:]
    while len(words) > 1 and words[-1] in AFTER:
        words = words[:-1]
    return "".join(words)


def forms(text: str) -> list[str]:
    """An entry's compact forms: as it stands, without the words around it, and with its words shortened."""
    words = plain_words(text)
    return sorted({"".join(words), compact(text), compact(" ".join(SHORT.get(w, w) for w in words))} - {""})


def tokens(form: str) -> list[str]:
    """Letters and letter pairs of a compact form, each numbered by occurrence."""
    seen, padded, out = Counter(), f"^{form}$", []
    for t in [*form, *(padded[i : i + 2] for i in range(len(padded) - 1))] if form else []:
        seen[t] += 1
        out.append(f"{t}{seen[t]}")
    return out


def _sets(df: DataFrame, value: str, make) -> DataFrame:
    """``df`` (field, id, ``value``) with ``form`` and ``tokens``, one row for each form that ``make`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, sets = [], [], []
            for i, v in enumerate(batch.column(2).to_pylist()):
                for form in make(v):
                    rows.append(i)
                    found.append(form)
                    sets.append(tokens(form))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(found, pa.string()), pa.array(sets, pa.list_(pa.string()))], ["field", "id", "form", "tokens"])

    kind = df.schema["id"].dataType.simpleString()
    return df.select("field", "id", value).mapInArrow(run, f"field string, id {kind}, form string, tokens array<string>")


def _least(n: int, threshold: float) -> int:
    """Tokens that a set of ``n`` shares at least with any set that is similar enough."""
    return math.ceil(threshold * n - 1e-9)


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


class Index:
    """Forms of the entries by the tokens of their prefixes."""

    def __init__(self, forms: list[tuple[str, int, str]], counts: dict[tuple[str, str], int], threshold: float) -> None:
        self.counts, self.threshold = counts, threshold
        self.forms = [(ref, form, frozenset(tokens(form))) for _, ref, form in forms]
        self.places: dict[tuple[str, str], list[tuple[int, int]]] = defaultdict(list)
        for n, (field, _, form) in enumerate(forms):
            for pos, t in enumerate(self.prefix(field, form)):
                self.places[field, t].append((n, pos))

    def prefix(self, field: str, form: str) -> list[str]:
        own = sorted(tokens(form), key=lambda t: (self.counts.get((field, t), 0), t))
        least = _least(len(own), self.threshold)
        return own[: len(own) - least + min(SHARED, least)]

    def candidates(self, field: str, form: str) -> Iterator[int]:
        """Numbers of the forms that may be similar enough."""
        n, last = 2 * len(form) + 1, {}
        least, found = _least(n, self.threshold), Counter()
        for pos, t in enumerate(self.prefix(field, form)):
            for k, at in self.places.get((field, t), ()):
                found[k] += 1
                last[k] = pos, at
        for k, shared in found.items():
            m = len(self.forms[k][2])
            if n >= self.threshold * m and m >= self.threshold * n and shared >= min(SHARED, least, _least(m, self.threshold)):
                rest = min(n - last[k][0], m - last[k][1]) - 1
                if shared + rest >= self.threshold / (1 + self.threshold) * (n + m) - 1e-9:
                    yield k

    def best(self, field: str, form: str) -> tuple[int, float] | None:
        own, found = frozenset(tokens(form)), []
        for k in self.candidates(field, form):
            ref, other, theirs = self.forms[k]
            both = len(own & theirs)
            similarity = both / (len(own) + len(theirs) - both)
            if similarity >= self.threshold:
                found.append((similarity, ref, other))
        top = max((x[0] for x in found), default=0)
        ties = [(ref, other) for similarity, ref, other in found if similarity == top]
        return (min((_edits(form, other), ref) for ref, other in ties)[1] if len(ties) > 1 else ties[0][0], top) if ties else None


def match_values(values: DataFrame, reference: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``field``, ``value``, ``ref_id`` and ``similarity`` of every distinct value of ``values`` (field, value) that means an entry.

    ``reference`` has ref_id, field, canonical and aliases (array). Values are made distinct first, so a
    value that a third of all rows share is one row. Null and blank values and values without letters match
    nothing; equal entries resolve to the lowest ref_id; an empty table on either side gives no row.
    Token counts are as many as an alphabet has letters and pairs. While they are no more than ``MAX_TOKENS`` and the
    entries have no more than ``MAX_FORMS`` forms, both are sent to every executor, and no candidate is shuffled;
    else sets and candidates are joined, with the same result.
    """
    typed = values.select("field", F.col("value").alias("id"), "value").filter("value is not null").distinct()
    # comparing costs far more than its few bytes tell, so the number of partitions is named and stays
    typed = typed.repartition(max(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), values.sparkSession.sparkContext.defaultParallelism), "field", "value")
    named = reference.select("field", F.col("ref_id").cast("long").alias("id"), F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).filter("name is not null").distinct()
    own = lambda v: [f] if (f := compact(v)) else []
    left, right = _sets(typed, "value", own), _sets(named, "name", forms)
    count = lambda df: df.select("field", F.explode("tokens").alias("token"))
    rarity = count(left).unionByName(count(right)).groupBy("field", "token").agg(F.count("*").alias("df"))
    counted = rarity.limit(MAX_TOKENS + 1).collect()
    listed = right.select("field", "id", "form").distinct().limit(MAX_FORMS + 1).collect()
    if len(counted) > MAX_TOKENS or len(listed) > MAX_FORMS:
        return _joined(left, right, rarity, threshold)
    index = Index(sorted((r["field"], r["id"], r["form"]) for r in listed), {(r["field"], r["token"]): r["df"] for r in counted}, threshold)
    sent = values.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            found = [index.best(f, form) if (form := compact(v)) else None for f, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            take = pa.array([i for i, x in enumerate(found) if x], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array([x[0] for x in found if x], pa.int64()), pa.array([x[1] for x in found if x], pa.float64())], ["field", "value", "ref_id", "similarity"])

    return typed.select("field", "value").mapInArrow(run, "field string, value string, ref_id long, similarity double")


def _joined(left: DataFrame, right: DataFrame, rarity: DataFrame, threshold: float) -> DataFrame:
    def ranked(df: DataFrame) -> DataFrame:
        each = df.select("field", "id", "form", F.explode("tokens").alias("token")).join(rarity, ["field", "token"]).groupBy("field", "id", "form")
        return each.agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("set")).withColumn("n", F.size("set")).withColumn("least", F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int"))

    def prefixed(df: DataFrame, side: str) -> DataFrame:
        rare = F.slice("set", F.lit(1), F.col("n") - F.col("least") + F.least(F.lit(SHARED), F.col("least")))
        return df.select("field", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "form", "n", "least")], F.explode(rare).alias("token"))

    left, right = ranked(left), ranked(right)
    sized = prefixed(left, "a").join(prefixed(right, "b"), ["field", "token"]).filter((F.col("n_b") >= threshold * F.col("n_a")) & (F.col("n_a") >= threshold * F.col("n_b")))
    met = sized.groupBy("field", "id_a", "form_a", "id_b", "form_b", "least_a", "least_b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= F.least(F.lit(SHARED), "least_a", "least_b"))
    side = lambda df, x: df.select("field", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "form", "set", "n")])
    pairs = met.join(side(left, "a"), ["field", "id_a", "form_a"]).join(side(right, "b"), ["field", "id_b", "form_b"]).withColumn("both", F.size(F.array_intersect("set_a", "set_b")))
    pairs = pairs.withColumn("similarity", F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).filter(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.levenshtein("form_a", "form_b")).alias("edits"), (-F.col("id_b")).alias("ref"))).alias("best")
    return pairs.groupBy("field", F.col("id_a").alias("value")).agg(best).select("field", "value", (-F.col("best.ref")).alias("ref_id"), "best.similarity")


def is_value(c: str):
    """Neither null nor only white space of any kind."""
    return F.length(F.regexp_replace(c, SPACE + "+", "")) > 0


def map_values(df: DataFrame, key: str, fields: list[str], reference: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``key``, ``field``, ``value``, ``ref_id`` (0 if it means no entry) and ``similarity`` of every value of ``df``'s ``fields``."""
    stacked = df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(key, "x.field", "x.value").filter(is_value("value"))
    found = match_values(stacked.select("field", "value"), reference, threshold)
    return stacked.join(found, ["field", "value"], "left").select(key, "field", "value", F.coalesce("ref_id", F.lit(0).cast("long")).alias("ref_id"), "similarity")
