"""Rows whose text contains another row's name, without comparing every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a name by which it is looked up.
GRAM = 8


def ascii_lower(text: Column) -> Column:
    """Lower case of A to Z only, as LIKE compares in the archive's first store."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def containing(texts: DataFrame, text: str, names: DataFrame, name: str, how: str = "inner") -> DataFrame:
    """``texts`` joined to the ``names`` whose ``name`` occurs in ``text`` (case of A to Z disregarded).

    A name is found by its first ``GRAM`` characters among the ``GRAM``-long pieces of the texts, an equi-join,
    and then tested; shorter names by pieces of their own length, the empty name by the empty piece. Null
    texts contain nothing; names are made distinct first; an empty side gives no match. Pieces travel with a digest of
    their text alone, so what is shuffled grows with the texts' length, not its square.
    """
    needles = names.filter(F.col(name).isNotNull()).distinct().withColumn("__needle", ascii_lower(F.col(name))).withColumn("__gram", F.substring("__needle", 1, GRAM))
    lengths = [r[0] for r in needles.select(F.length("__gram")).distinct().collect()]  # at most GRAM + 1 numbers
    hay = texts.withColumn("__text", ascii_lower(F.col(text))).withColumn("__hay", F.unhex(F.md5("__text")))
    n = F.length("__text")
    piece = lambda k: lambda i: F.substring("__text", i, F.lit(k))
    grams = [F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), piece(k))).otherwise(F.array().cast("array<string>")) for k in sorted(lengths)]
    pieces = F.array_distinct(F.concat(*grams)) if grams else F.array().cast("array<string>")
    met = hay.select("__hay", F.explode(pieces).alias("__gram")).join(needles, "__gram").drop("__gram").distinct()
    hits = hay.join(met, "__hay").filter(F.contains("__text", "__needle")).drop("__hay", "__needle", "__text")
    if how == "inner":
        return hits
    return hits.unionByName(_without(texts, hits), allowMissingColumns=True)


def _without(texts: DataFrame, hits: DataFrame) -> DataFrame:
    found = hits.select(*[F.col(c).alias(f"__{c}") for c in texts.columns]).distinct()
    return texts.join(found, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in texts.columns], "left_anti")
