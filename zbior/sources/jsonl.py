"""JSON lines in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POSTS = "id string, content string, text string, content_urls array<string>"


def read_jsonl(spark: SparkSession, path: str, schema: str = POSTS) -> DataFrame:
    """Records of a JSON lines file or folder; a line that is not JSON gives a row of nulls."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
