"""Queries of the general data-cleaning problems (time stamps and packed fields)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zbior.operators import packed, zones
from zbior.sources.tables import spread, table

#: Table, key and column of each displayed date.
DATES = [("forum_posts", "post_date"), ("forum_threads", "last_post_date"), ("forum_users", "join_date")]
#: Table, column and kind of each packed field.
PACKED = [("articles", "article_authors", "names"), ("articles", "article_tags", "tags"), ("articles", "article_image_urls", "urls"), ("forum_posts", "content_urls", "urls")]


def _instants(spark: SparkSession, folder: str) -> DataFrame:
    parts = [spread(table(spark, folder, t, "id", c, "updated_at")).select(F.lit(c).alias("field"), F.col("id").alias("rec_id"), F.col(c).alias("raw"), "updated_at") for t, c in DATES]
    return zones.to_instants(reduce(DataFrame.unionByName, parts), "raw", "updated_at")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every displayed date that fixes a calendar day, as seconds since 1970 UTC."""
    return _instants(spark, folder).filter("epoch_s is not null").select("field", "rec_id", "epoch_s").distinct()


def p6_states(spark: SparkSession, folder: str) -> DataFrame:
    """How many values of each field were plain, ambiguous, skipped, relative, no date or missing."""
    return _instants(spark, folder).groupBy("field", "date_state").agg(F.count("*").alias("n"))


def _values(spark: SparkSession, folder: str) -> DataFrame:
    parts = [packed.split_packed(table(spark, folder, t, "id", c), "id", c, kind).withColumn("field", F.lit(c)) for t, c, kind in PACKED]
    return reduce(DataFrame.unionByName, parts)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of the packed fields with its position."""
    return _values(spark, folder).select("field", "rec_id", "pos", "val").distinct()


def p7_malformed(spark: SparkSession, folder: str) -> DataFrame:
    """Values whose quotes or brackets do not close, with the field and position."""
    return _values(spark, folder).filter("malformed").select("field", "rec_id", "pos", "val").distinct()


QUERIES = {"p6_found": p6_found, "p6_states": p6_states, "p7_found": p7_found, "p7_malformed": p7_malformed}
