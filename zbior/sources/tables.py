"""The archive's tables as DataFrames, and the row that counts where a row was fetched again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zbior.session import cut_lineage


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """``folder/name.parquet``; with ``columns``, only those (the scan reads no others)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that costs more than reading.

    A scan of so few splits is small, so moving its rows costs little; a large one stays as it is read.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if _few(df) else df


def _few(df: DataFrame) -> bool:
    return df._jdf.queryExecution().toRdd().getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism


def latest(df: DataFrame, keys: list[str], order: list[str | Column], tie: list[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``order``, then the greatest ``tie``.

    An aggregate with map-side combine, not a window, so that a key with a third of all rows is
    reduced before the shuffle. Rows that agree in everything named are interchangeable: any is kept.
    Null keys form one key, as in GROUP BY. An empty table stays empty.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order], *[F.col(c) for c in (tie or [])])
    row = F.max_by(F.struct(*[F.col(c) for c in rest]), rank).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


#: Most keys fetched again that are sent to every executor.
BROADCAST_KEYS = 2_000_000


def latest_wide(df: DataFrame, key: str, order: str) -> DataFrame:
    """``latest`` for wide rows of which few were fetched again: texts are not shuffled.

    The keys with several rows are found from the narrow columns; while they are few enough, each task drops
    the older rows by looking them up, else rows are reduced by key, as they are where the scan is too small to
    busy all cores and a shuffle spreads it. The rows are the same either way: null keys are one key, and of rows whose
    ``order`` is null everywhere one stays.
    """
    if _few(df):
        return latest(df, [key], [order])
    each = df.groupBy(key, order).agg(F.count("*").alias("__n"))
    rank = F.struct(order)
    again = each.groupBy(key).agg(F.sum("__n").alias("__rows"), F.max(rank).alias("__last"), F.max_by("__n", rank).alias("__top")).filter("__rows > 1")
    again = cut_lineage(again.select(F.col(key).alias("__key"), F.col("__last")[order].alias("__last"), (F.col("__top") > 1).alias("__tied")))
    count, tied = again.agg(F.count("*"), F.count_if("__tied")).first()
    if count > BROADCAST_KEYS:
        return latest(df, [key], [order])
    same = F.col(key).eqNullSafe(F.col("__key"))
    plain = df.join(F.broadcast(again), same, "left").filter(F.col("__tied").isNull() | F.col(order).eqNullSafe(F.col("__last")) & ~F.col("__tied")).select(df.columns)
    if not tied:
        return plain
    return plain.unionByName(latest(df.join(F.broadcast(again.filter("__tied").select("__key")), same, "left_semi"), [key], [order]).select(df.columns))
