"""zbior: a Spark-native engine for forum and periodical archives.

Subpackages: ``sources`` (readers, writers, HTML and JSONL), ``functions`` (column expressions),
``operators`` (joins, upserts, resolution, time zones, packed fields), ``analyzers`` (per-document
annotation), ``plans`` (named queries and their SQL), ``streaming`` (continuous upsert) and the
optional ``llm`` (training-data operators), which nothing else imports.
"""

__version__ = "0.1.0"
