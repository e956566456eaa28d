"""The archive's relational model over its stored tables: one row per thing, and what analysis derives from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zbior.functions import text as tx
from zbior.functions import tokens as tk
from zbior.functions import urls as ur
from zbior.sources.tables import latest, latest_wide, table

# Categories of the archive's own domains, besides the general lists.
OWN_DOMAINS = {
    "religious": ("chorki.example",),
    "educational": ("encyklo.example", "czytelnia.example"),
    "media": ("wideo.latarnia.example", "filmoteka.example", "nowiny-brzegu.example"),
    "social": ("spolecznik.example",),
}
#: Addresses in a packed text, for statistics (the packed-field parser gives each value exactly).
ADDRESS = r"https?://[^\s\"';,|\]]+"


def posts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Each post as last fetched."""
    return latest_wide(table(spark, folder, "forum_posts", "id", *columns, "updated_at"), "id", "updated_at").drop("updated_at")


def threads(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return latest(table(spark, folder, "forum_threads", "id", *columns, "updated_at"), ["id"], ["updated_at"]).drop("updated_at")


def users(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return latest(table(spark, folder, "forum_users", "id", *columns, "updated_at"), ["id"], ["updated_at"]).drop("updated_at")


def places(spark: SparkSession, folder: str) -> DataFrame:
    """``thread_id`` with its section and forum; every thread in one section, every section in one forum."""
    sections = table(spark, folder, "forum_sections", "id", "forum_id", "title").select(F.col("id").alias("section_id"), "forum_id", F.col("title").alias("section"))
    forums = table(spark, folder, "forums", "id", "spider_name", "title").select(F.col("id").alias("forum_id"), F.col("spider_name").alias("forum"), F.col("title").alias("forum_title"))
    return threads(spark, folder, "section_id").withColumnRenamed("id", "thread_id").join(sections, "section_id").join(forums, "forum_id")


def post_words(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Each post's words in order as one array ``w`` (lower-case), with id and thread_id."""
    return posts(spark, folder, "thread_id", "content", *columns).withColumn("w", tk.tokens(F.col("content"))).drop("content")


def annotate(words: DataFrame) -> DataFrame:
    """``words`` (token, …) with the default annotation of each token."""
    t = F.col("token")
    return words.withColumns({"lemma": t, "pos": tk.word_class(t), "is_alpha": t.rlike(r"^\p{L}+$"), "is_stop": t.isin(tk.STOP), "morph": tk.morphology(t)})


def post_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per word of a post: id, thread_id, position, token, and the default annotation."""
    return annotate(post_words(spark, folder).select("id", "thread_id", F.posexplode("w").alias("position", "token")))


def post_linguistics(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Statistics of each post with words: sentences, words, characters, readability, sentiment."""
    own = posts(spark, folder, "thread_id", "content", *columns).withColumn("w", tk.tokens(F.col("content"))).filter(F.size("w") > 0)
    n, sentences, chars = F.size("w").cast("long"), tk.sentence_count(F.col("content")), F.length("content").cast("long")
    out = own.withColumns({"word_count": n, "sentence_count": sentences, "char_count": chars, "s": tk.sentiment(F.col("w"))})
    n, sentences, chars = F.col("word_count"), F.col("sentence_count"), F.col("char_count")
    return out.withColumns({
        "avg_sentence_length": n / sentences, "readability": tk.readability(n, sentences, chars), "raw_readability": tk.raw_readability(n, sentences, chars),
        "polarity": F.col("s.polarity"), "subjectivity": F.col("s.subjectivity"),
    }).drop("w", "s", "content")


def post_urls(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """One row per address of a post: id, thread_id, url, domain, category, trust, url_type, and ``columns`` of the post."""
    found = F.regexp_extract_all(F.replace("content_urls", F.lit("\\/"), F.lit("/")), F.lit(ADDRESS), F.lit(0))
    each = posts(spark, folder, "thread_id", "content_urls", *columns).select("id", "thread_id", *columns, F.explode(found).alias("url"))
    out = each.withColumn("domain", ur.domain(F.col("url"))).withColumn("category", ur.domain_category(F.col("domain"), OWN_DOMAINS))
    return out.withColumns({"trust": ur.trust_score(F.col("category")), "url_type": ur.url_type(F.col("url"), F.col("domain"))})


def post_entities(spark: SparkSession, folder: str) -> DataFrame:
    """One row per entity that the default annotator finds: id, thread_id, label, entity."""
    own = posts(spark, folder, "thread_id", "content")
    labelled = lambda label: lambda e: F.struct(F.lit(label).alias("label"), e.alias("entity"))
    found = F.concat(*[F.transform(F.regexp_extract_all("content", F.lit(p), F.lit(0)), labelled(k)) for k, p in tk.ENTITIES.items()])
    return own.select("id", "thread_id", F.explode(found).alias("e")).select("id", "thread_id", "e.label", "e.entity").filter(tx.strip(F.col("entity")) != "")


AUTHOR_SEPARATORS = r"[;|/&,\n\[\]\"']| i | oraz "


def authors(spark: SparkSession, folder: str) -> DataFrame:
    """Names of authors: the parts of the packed field with more than three characters."""
    parts = F.transform(F.split("article_authors", AUTHOR_SEPARATORS), tx.strip)
    return table(spark, folder, "articles", "article_authors").select(F.explode(parts).alias("name")).filter("length(name) > 3").distinct()
