"""Tables of which each write is a new version beside the old one; the last whole version counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Versions that stay for readers that have begun.
KEPT = 2


def filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the versions that were written whole, ascending."""
    fs, path = filesystem(spark, target)
    if not fs.exists(path):
        return []
    make = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n[2:]) for s in fs.listStatus(path) if (n := s.getPath().getName()).startswith("v=") and fs.exists(make(s.getPath(), "_SUCCESS")))


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The table as last written whole, None before the first time."""
    done = versions(spark, target)
    return spark.read.parquet(f"{target}/v={done[-1]}") if done else None


def write(df: DataFrame, target: str, number: int | None = None) -> None:
    """``df`` as version ``number`` (the next one by default) of ``target``; of older versions the last ``KEPT`` - 1 stay."""
    spark = df.sparkSession
    done = versions(spark, target)
    df.write.mode("overwrite").parquet(f"{target}/v={(done[-1] + 1 if done else 0) if number is None else number}")
    for old in versions(spark, target)[:-KEPT]:
        fs, path = filesystem(spark, f"{target}/v={old}")
        fs.delete(path, True)
