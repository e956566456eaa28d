"""Finding the rows that scraped rows belong to: threads by id in the link, sections by link or id, users by name.

All are equi-joins on parsed parts; what finds nothing comes out as rejected instead of vanishing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zbior.functions import urls


def surrogate(*natural: str):
    """A deterministic id from a natural key."""
    return F.xxhash64(*natural)


def by_thread_param(posts: DataFrame, threads: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """``posts`` with ``resolved_thread`` by the ``t`` parameter of their link within the same host, and the rejected ones."""
    key = lambda c: [urls.domain(F.col(c)).alias("__host"), urls.query_param(F.col(c), "t").alias("__t")]
    own = threads.select(F.col("id").alias("resolved_thread"), *key("url")).filter("__t is not null").groupBy("__host", "__t").agg(F.min("resolved_thread").alias("resolved_thread"))
    joined = posts.select("*", *key(url)).join(own, ["__host", "__t"], "left").drop("__host", "__t")
    return joined.filter("resolved_thread is not null"), joined.filter("resolved_thread is null").drop("resolved_thread")


def sections_of_threads(threads: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``threads`` with ``resolved_section``: by the section's link without its session, else by the ``f`` parameter on the
    same host (the lowest id of several), and the rejected ones."""
    plain = sections.select(F.col("id").alias("by_url"), urls.without_session(F.col("url")).alias("__link")).groupBy("__link").agg(F.min("by_url").alias("by_url"))
    param = sections.select(F.col("id").alias("by_f"), urls.domain(F.col("url")).alias("__host"), urls.query_param(F.col("url"), "f").alias("__f")).filter("__f is not null").groupBy("__host", "__f").agg(F.min("by_f").alias("by_f"))
    joined = (
        threads.select("*", urls.without_session(F.col("section_url")).alias("__link"), urls.domain(F.col("url")).alias("__host"), urls.query_param(F.col("url"), "f").alias("__f"))
        .join(plain, "__link", "left").join(param, ["__host", "__f"], "left")
        .withColumn("resolved_section", F.coalesce("by_url", "by_f")).drop("__link", "__host", "__f", "by_url", "by_f")
    )
    return joined.filter("resolved_section is not null"), joined.filter("resolved_section is null").drop("resolved_section")


def by_username(posts: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``posts`` with ``resolved_user`` of the same username (lowest id of several), and the rejected ones."""
    own = users.filter("username is not null").groupBy("username").agg(F.min("id").alias("resolved_user"))
    joined = posts.join(own, "username", "left")
    return joined.filter("resolved_user is not null"), joined.filter("resolved_user is null").drop("resolved_user")


def matching(child: DataFrame, parent: DataFrame, foreign: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """``child`` rows whose ``foreign`` is a ``key`` of ``parent``, and the rejected ones (null keys among them)."""
    ids = parent.select(F.col(key).alias(foreign)).distinct()
    return child.join(ids, foreign, "left_semi"), child.join(ids, foreign, "left_anti")
