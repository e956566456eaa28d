"""Continuous upsert: new files of rows are merged into a table as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from zbior.operators.upsert import replace_by_key
from zbior.sources import versioned

#: Buckets of a table by the hash of its key.
BUCKETS = 64


def _places(spark: SparkSession, target: str, before: int | None = None) -> dict[int, list[str]]:
    """For each bucket the folders of its versions that were written whole (up to ``before``), oldest first."""
    fs, _ = versioned.filesystem(spark, target)
    out: dict[int, list[str]] = {}
    for v in versioned.versions(spark, target):
        if before is None or v < before:
            for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v={v}")):
                if (name := s.getPath().getName()).startswith("bucket="):
                    out.setdefault(int(name[7:]), []).append(f"{target}/v={v}/{name}")
    return out


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The table as of the last batch that was written whole, None before the first."""
    places = _places(spark, target)
    return spark.read.parquet(*(p[-1] for p in places.values())) if places else None


def upsert_stream(source: DataFrame, target: str, checkpoint: str, keys: list[str], seq: str, available_now: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """A query that merges each batch of ``source`` into the table at ``target`` (last ``seq`` wins).

    The table lies in ``buckets`` by the hash of ``keys``; a batch writes those that it touches beside their old
    versions, and no others; versions that two later ones follow are removed. A batch that is run again after a
    failure overwrites its own version and changes nothing else.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())  # as many as there are buckets at most
        if not touched:
            return
        places = _places(spark, target, number)
        before = [places[b][-1] for b in touched if b in places]
        old = spark.read.parquet(*before) if before else batch.limit(0)
        merged = replace_by_key(old, batch, keys, seq).withColumn("bucket", bucket)
        merged.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={number}")
        fs, _ = versioned.filesystem(spark, target)
        for own in _places(spark, target).values():
            for p in own[: -versioned.KEPT]:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(p), True)

    writer = source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, time: str, group: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of a stream by ``group`` and event-time window, closed when the watermark of ``late`` has passed.

    ``time`` may have no zone; it is then read in the session's.
    """
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(F.window("__t", width), group).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), group, "n")
