"""Upserts into relational tables, as whole-frame operations that may be repeated without harm.

``seq`` orders writes; the row written last wins. A key is reduced by a map-side combined aggregate, so one
that holds a third of all rows never gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zbior.sources.tables import latest


def replace_by_key(existing: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """INSERT OR REPLACE: of all rows with one key, the last written stays, with nothing of the others.

    Columns that one side lacks are null there. Rows whose key has a null never conflict and all stay.
    """
    both = existing.unionByName(new, allowMissingColumns=True)
    keyed = F.lit(True)
    for k in keys:
        keyed &= F.col(k).isNotNull()
    return latest(both.filter(keyed), keys, [seq]).select(both.columns).unionByName(both.filter(~keyed))


def update_on_conflict(existing: DataFrame, new: DataFrame, keys: list[str], seq: str, keep: list[str]) -> DataFrame:
    """ON CONFLICT DO UPDATE: the last write wins, but the columns in ``keep`` stay as first written.

    Rows whose key has a null never conflict and all stay.
    """
    both = existing.unionByName(new, allowMissingColumns=True)
    keyed = F.lit(True)
    for k in keys:
        keyed &= F.col(k).isNotNull()
    rest = [c for c in both.columns if c not in keys]
    last = F.max_by(F.struct(*[F.col(c) for c in rest if c not in keep]), F.col(seq)).alias("__last")
    first = F.min_by(F.struct(*[F.col(c) for c in keep]), F.col(seq)).alias("__first")
    merged = both.filter(keyed).groupBy(*keys).agg(last, first)
    columns = [F.col(c) if c in keys else F.col("__first")[c].alias(c) if c in keep else F.col("__last")[c].alias(c) for c in both.columns]
    return merged.select(*columns).unionByName(both.filter(~keyed))


def replace_children(existing: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Delete-then-reinsert: the children of every parent in ``new`` are replaced whole; others stay."""
    return existing.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new, allowMissingColumns=True)


def domain_table(urls: DataFrame, seen_at: str) -> DataFrame:
    """Domains with references counted and first and last seen, recomputed from ``urls`` (domain, ``seen_at``).

    A running counter would count a post again each time it is stored; counting what is there does not.
    """
    return urls.filter("domain is not null").groupBy("domain").agg(F.count("*").alias("total_references"), F.min(seen_at).alias("first_seen"), F.max(seen_at).alias("last_seen")).withColumn("id", F.xxhash64("domain"))


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with the missing ones of ``columns`` (name to type) as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})
