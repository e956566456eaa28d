"""From pages or stored tables to analysed tables, and what a run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zbior.analyzers import AnalysisConfig, run
from zbior.archive import posts_of_pages as posts_of_pages
from zbior.sources import jsonl


def analyze_jsonl(spark: SparkSession, source: str, target: str, config: AnalysisConfig) -> DataFrame:
    """The records of a JSON lines file with their analyses, written as JSON lines to ``target``."""
    out = run(jsonl.read_jsonl(spark, source), config)
    jsonl.write_jsonl(out, target)
    return out


def status(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """What ``folder`` holds: table counts, counts of each forum, progress of analyses."""
    from zbior.plans import QUERIES

    return {name: QUERIES[name](spark, folder) for name in ("table_counts", "crawl_levels", "analysis_progress")}
