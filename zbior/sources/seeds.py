"""The sources that the archive knows: boards with their style of markup, and weeklies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Boards (name, title, style of markup) and weeklies (name, address).
FORUMS = [
    ("dolina_modlitwy", "Dolina Modlitwy", "lists"),
    ("radio_katolik", "radiokatolik.pl", "tables"),
    ("wiara", "wiara.pl", "tables"),
    ("z_chrystusem", "Z Chrystusem", "lists"),
]
WEEKLIES = [
    ("Gość Niedzielny", "https://www.gosc.pl"),
    ("Idziemy", "https://idziemy.pl"),
    ("Niedziela", "https://www.niedziela.pl"),
    ("Przewodnik Katolicki", "https://www.przewodnik-katolicki.pl"),
]


def list_sources(spark: SparkSession) -> DataFrame:
    """``name``, ``title`` and ``style`` of every board."""
    return spark.createDataFrame(FORUMS, "name string, title string, style string")


def weeklies(spark: SparkSession) -> DataFrame:
    """``name`` and ``url`` of every weekly, the seeds of a crawl."""
    return spark.createDataFrame(WEEKLIES, "name string, url string")
