"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zbior.llm import canon, leakage, lines, pii, spans, split, tokens, toxic
from zbior.sources.tables import latest, spread, table


def _mapped(spark: SparkSession, folder: str) -> DataFrame:
    return canon.map_values(table(spark, folder, "forum_users", "id", "localization", "religion"), "id", ["localization", "religion"], table(spark, folder, "canon_values"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """For each typed place and religion the entry it means, 0 if none."""
    return _mapped(spark, folder).select(F.col("id").alias("user_id"), "field", "ref_id").distinct()


def p1_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Typed values that mean no entry, and how many rows have them."""
    return _mapped(spark, folder).filter("ref_id = 0").groupBy("field", "value").agg(F.count("*").alias("n"))


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "forum_posts", "id", "content"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of posts that share at least 120 identical characters in a row."""
    return spans.shared_pairs(_contents(spark, folder), "id", "content", 120).select(F.col("id_a").alias("post_a"), F.col("id_b").alias("post_b"))


def p2_shared(spark: SparkSession, folder: str) -> DataFrame:
    """For each post with shared passages: its class of equal contents, with how many others it shares, and how many of its characters."""
    return spans.shared_characters(_contents(spark, folder), "id", "content", 120).withColumnRenamed("id", "post_id")


def _details(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_details(spread(table(spark, folder, "forum_posts", "id", "content")), "id", "content")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every personal detail in a post, with its kind and place."""
    return _details(spark, folder).select(F.col("id").alias("post_id"), F.explode("details").alias("d")).select("post_id", "d.kind", F.col("d.start").cast("long").alias("start_char")).distinct()


def p3_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every post's content with typed placeholders in the place of personal details."""
    return _details(spark, folder).select(F.col("id").alias("post_id"), "redacted", F.size("details").cast("long").alias("n_details")).distinct()


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    posts = table(spark, folder, "forum_posts", "id", "content")
    return toxic.score_posts(spread(posts), "id", "content", toxic.fit(posts, table(spark, folder, "post_labels"), "id", "content"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Abusive, hateful or sexually explicit posts."""
    return _scores(spark, folder).filter("toxic").select(F.col("id").alias("post_id")).distinct()


def p4_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every post's score."""
    return _scores(spark, folder).select(F.col("id").alias("post_id"), "score", "toxic").distinct()


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    """For each forum the number of posts, of bad ones, and their share."""
    posts = _scores(spark, folder).groupBy("id").agg(F.max("toxic").alias("toxic")).join(table(spark, folder, "forum_posts", "id", "thread_id").distinct(), "id")
    threads = latest(table(spark, folder, "forum_threads", "id", "section_id", "updated_at"), ["id"], ["updated_at"])
    sections = table(spark, folder, "forum_sections", "id", "forum_id")
    forums = table(spark, folder, "forums", "id", "title")
    per_thread = posts.groupBy("thread_id").agg(F.count("*").alias("n"), F.count_if("toxic").alias("bad"))
    chain = per_thread.join(threads.select(F.col("id").alias("thread_id"), "section_id"), "thread_id").join(sections.select(F.col("id").alias("section_id"), "forum_id"), "section_id")
    rates = chain.join(forums.select(F.col("id").alias("forum_id"), F.col("title").alias("forum")), "forum_id").groupBy("forum_id", "forum")
    return rates.agg(F.sum("n").alias("n_posts"), F.sum("bad").alias("n_toxic"), F.round(F.sum("bad") / F.sum("n"), 4).alias("rate"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines.repeated_lines(spread(table(spark, folder, "articles", "id", "weekly_name", "article_url", "article_content")), "id", "article_url", "weekly_name", "article_content", 6)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines in at least six articles of one weekly."""
    return _lines(spark, folder).select(F.col("id").alias("article_id"), "line_no")


def p5_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Every article's content without the repeated lines."""
    articles = table(spark, folder, "articles", "id", "weekly_name", "article_url", "article_content")
    return lines.without_lines(articles, "id", "article_content", _lines(spark, folder)).select(F.col("id").alias("article_id"), "clean", "n_cut")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_column(spread(table(spark, folder, "documents", "doc_id", "text")), "doc_id", "text")


def _leaks(spark: SparkSession, folder: str, min_match: int) -> DataFrame:
    return leakage.find_leaks(spread(table(spark, folder, "documents", "doc_id", "text")), table(spark, folder, "eval_items", "item_id", "item_text"), min_match=min_match)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with at least 20 consecutive words of an evaluation item."""
    return _leaks(spark, folder, 20).select("doc_id", "item_id").distinct()


def p9_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose tiles cover at least half of an item's words, in any order."""
    return _leaks(spark, folder, 8).filter("covered * 2 >= item_words").select("doc_id", "item_id", "tiles", "longest", "covered", "item_words")


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_oversized(spread(table(spark, folder, "documents", "doc_id", "text")), limit=1000, overlap=50)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of more than 1 000 tokens."""
    return _pieces(spark, folder).filter("piece_no = 0").select("doc_id").distinct()


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every document of more than 1 000 tokens."""
    return _pieces(spark, folder)


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p2_found, p2_shared, p3_found, p3_redacted, p4_found, p4_scores, p4_rates, p5_found, p5_clean, p8_ids, p9_found, p9_coverage, p10_found, p10_pieces)}
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"
_LINES = f"""lines AS (SELECT id, weekly_name, article_url, unnest(generate_series(1, len(l))) AS line_no, unnest(l) AS line FROM (SELECT *, string_split(article_content, chr(10)) AS l FROM articles WHERE article_content IS NOT NULL)),
plain AS (SELECT *, regexp_replace(trim(regexp_replace(lower(line), '{_SPACE}', ' ', 'g')), '\\p{{Nd}}+', '0', 'g') AS form FROM lines),
often AS (SELECT weekly_name, form FROM plain WHERE form <> '' GROUP BY weekly_name, form HAVING count(DISTINCT article_url) >= 6),
cut AS (SELECT DISTINCT p.id, p.line_no FROM plain p JOIN often o ON p.weekly_name = o.weekly_name AND p.form = o.form)"""
_WORDS = "regexp_extract_all(lower(replace(replace(strip_accents(nfc_normalize({0})), 'ł', 'l'), 'Ł', 'L')), '[\\p{{L}}\\p{{N}}]+')"
_RUNS = "SELECT {0}, array_to_string(w[i:i + 19], ' ') AS run FROM (SELECT {0}, w, unnest(generate_series(1, len(w) - 19)) AS i FROM (SELECT {0}, {1} AS w FROM {2}) WHERE len(w) >= 20)"

#: SQL with the same rows, by brute force where that is fast enough on whole tables.
SQL = {
    "p2_found": """WITH runs AS (SELECT id, substring(content, i, 120) AS run FROM (SELECT id, content, unnest(generate_series(1, length(content) - 119)) AS i FROM (SELECT DISTINCT id, content FROM forum_posts WHERE length(content) >= 120))),
met AS (SELECT run FROM runs GROUP BY run HAVING min(id) < max(id)), shared AS (SELECT DISTINCT r.id, r.run FROM runs r JOIN met ON r.run = met.run)
SELECT DISTINCT a.id AS post_a, b.id AS post_b FROM shared a JOIN shared b ON a.run = b.run AND a.id < b.id""",
    "p2_shared": """WITH c AS (SELECT content, min(id) AS class_id, count(DISTINCT id) - 1 AS n_copies FROM forum_posts WHERE length(content) >= 120 GROUP BY content),
runs AS (SELECT content, i, substring(content, i, 120) AS run FROM (SELECT content, unnest(generate_series(1, length(content) - 119)) AS i FROM c)),
met AS (SELECT run FROM runs GROUP BY run HAVING min(content) < max(content)), shared AS (SELECT r.content, r.i, r.run FROM runs r JOIN met USING (run)),
chars AS (SELECT content, sum(least(120, coalesce(later - i, 120))) AS covered FROM (SELECT content, i, lead(i) OVER (PARTITION BY content ORDER BY i) AS later FROM shared) GROUP BY content),
links AS (SELECT a.content, count(DISTINCT b.content) AS n_links FROM (SELECT DISTINCT content, run FROM shared) a JOIN (SELECT DISTINCT content, run FROM shared) b ON a.run = b.run AND a.content <> b.content GROUP BY a.content)
SELECT DISTINCT p.id AS post_id, c.class_id, c.n_copies, coalesce(l.n_links, 0) AS n_links, CAST(CASE WHEN c.n_copies > 0 THEN length(c.content) ELSE h.covered END AS BIGINT) AS shared_chars
FROM forum_posts p JOIN c ON p.content = c.content LEFT JOIN chars h ON h.content = c.content LEFT JOIN links l ON l.content = c.content WHERE c.n_copies > 0 OR h.covered IS NOT NULL""",
    "p5_found": f"WITH {_LINES} SELECT id AS article_id, line_no FROM cut",
    "p5_clean": f"""WITH {_LINES}, kept AS (SELECT l.id, string_agg(line, chr(10) ORDER BY l.line_no) FILTER (c.id IS NULL) AS clean, count(c.id) AS n_cut FROM lines l LEFT JOIN cut c ON l.id = c.id AND l.line_no = c.line_no GROUP BY l.id)
SELECT a.id AS article_id, CASE WHEN a.article_content IS NOT NULL THEN coalesce(clean, '') END AS clean, coalesce(n_cut, 0) AS n_cut FROM articles a LEFT JOIN kept k ON a.id = k.id""",
    "p9_found": f"""WITH d AS ({_RUNS.format("doc_id", _WORDS.format("text"), "documents")}), e AS ({_RUNS.format("item_id", _WORDS.format("item_text"), "eval_items")}) SELECT DISTINCT doc_id, item_id FROM d JOIN e ON d.run = e.run""",
}
