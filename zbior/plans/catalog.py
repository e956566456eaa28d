"""The catalogue of analytic queries over forums and weeklies, each with the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zbior.functions import tokens as tk
from zbior.functions import urls as ur
from zbior.operators.containment import ascii_lower, containing
from zbior.plans import model
from zbior.plans.model import OWN_DOMAINS
from zbior.plans.model_sql import MODEL, RELIGIOUS, quoted
from zbior.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
# Keywords of the two vocabulary queries, and parts of place names.
KEYWORDS = "bóg jezus chrystus modlitwa wiara kościół".split()
VOCABULARY = [*KEYWORDS, "duch", "święty"]
PLACES = ["Watykan", "Rzym", "Kraków", "Częstochowa"]
TOWNS = ["Górne", "Dolne", "Leśne", "Stare"]


def query(sql: str, prelude: bool = True):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = (MODEL if prelude else "") + sql
        return f

    return register


def _where(spark: SparkSession, folder: str, facts: DataFrame) -> DataFrame:
    """``facts`` (thread_id, …) with forum and section."""
    return facts.join(model.places(spark, folder), "thread_id")


def _forums_and(spark: SparkSession, folder: str, counts: DataFrame) -> DataFrame:
    """Every forum, with ``counts`` (forum_id, …) where there are any."""
    forums = table(spark, folder, "forums", "id", "spider_name", "title").select(F.col("id").alias("forum_id"), F.col("spider_name").alias("forum"), "title")
    return forums.join(counts, "forum_id", "left")


@query(""", per_forum AS (SELECT forum_id, count(*) AS posts_count, count(DISTINCT user_id) AS users_count, min(created_at) AS first_post, max(created_at) AS last_post FROM (SELECT p.*, forum_id FROM posts p JOIN places USING (thread_id)) GROUP BY forum_id)
SELECT spider_name AS forum, title, coalesce(posts_count, 0) AS posts_count, coalesce(users_count, 0) AS users_count, (SELECT count(*) FROM places WHERE forum_id = forums.id) AS threads_count, first_post, last_post FROM forums LEFT JOIN per_forum ON forum_id = id""")
def forum_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Posts, users and threads of each forum, with the first and last post.

    Ids belong to one thread, section and forum, so posts are counted per thread before any join; only the
    users need a distinct count.
    """
    posts, places = model.posts(spark, folder, "thread_id", "user_id", "created_at"), model.places(spark, folder)
    per_thread = posts.groupBy("thread_id").agg(F.count("*").alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    counts = places.join(per_thread, "thread_id", "left").groupBy("forum_id").agg(F.sum("n").alias("posts_count"), F.count("*").alias("threads_count"), F.min("first").alias("first_post"), F.max("last").alias("last_post"))
    people = posts.select("thread_id", "user_id").distinct().join(places, "thread_id").groupBy("forum_id").agg(F.count_distinct("user_id").alias("users_count"))
    out = _forums_and(spark, folder, counts.join(people, "forum_id", "left")).fillna(0, ["posts_count", "users_count", "threads_count"])
    return out.select("forum", "title", "posts_count", "users_count", "threads_count", "first_post", "last_post").orderBy(F.desc("posts_count"))


@query("""SELECT spider_name AS forum, (SELECT count(*) FROM posts JOIN places USING (thread_id) WHERE forum_id = forums.id) AS posts_count FROM forums""")
def forum_post_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts of each forum."""
    counts = _where(spark, folder, model.posts(spark, folder, "thread_id").groupBy("thread_id").agg(F.count("*").alias("n"))).groupBy("forum_id").agg(F.sum("n").alias("posts_count"))
    return _forums_and(spark, folder, counts).fillna(0).select("forum", "posts_count").orderBy(F.desc("posts_count"))


@query("""SELECT spider_name AS forum, (SELECT count(*) FROM (SELECT p.*, forum_id FROM posts p JOIN places USING (thread_id)) WHERE forum_id = forums.id) AS posts, (SELECT count(*) FROM places WHERE forum_id = forums.id) AS threads, (SELECT count(DISTINCT user_id) FROM (SELECT p.*, forum_id FROM posts p JOIN places USING (thread_id)) WHERE forum_id = forums.id) AS users FROM forums""")
def live_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Counts while a crawl runs: posts, distinct threads and users."""
    return forum_activity(spark, folder).select("forum", F.col("posts_count").alias("posts"), F.col("threads_count").alias("threads"), F.col("users_count").alias("users"))


@query("""SELECT spider_name AS forum, title, (SELECT count(*) FROM forum_sections WHERE forum_id = forums.id) AS sections, (SELECT count(*) FROM places WHERE forum_id = forums.id) AS threads, (SELECT count(DISTINCT user_id) FROM (SELECT p.*, forum_id FROM posts p JOIN places USING (thread_id)) WHERE forum_id = forums.id) AS users, (SELECT count(*) FROM (SELECT p.*, forum_id FROM posts p JOIN places USING (thread_id)) WHERE forum_id = forums.id) AS posts FROM forums""")
def crawl_levels(spark: SparkSession, folder: str) -> DataFrame:
    """How many sections, threads, users and posts each forum has."""
    sections = table(spark, folder, "forum_sections", "forum_id").groupBy("forum_id").agg(F.count("*").alias("sections")).join(table(spark, folder, "forums", "id", "spider_name").select(F.col("id").alias("forum_id"), F.col("spider_name").alias("forum")), "forum_id")
    out = forum_activity(spark, folder).join(sections.select("forum", "sections"), "forum", "left").fillna(0, ["sections"])
    return out.select("forum", "title", "sections", F.col("threads_count").alias("threads"), F.col("users_count").alias("users"), F.col("posts_count").alias("posts")).orderBy(F.desc("posts"))


@query("""SELECT section_id, section, count(*) AS posts_count, count(DISTINCT thread_id) AS threads_count FROM posts JOIN places USING (thread_id) GROUP BY section_id, section ORDER BY posts_count DESC, section_id LIMIT 10""")
def top_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The ten sections with most posts."""
    per_thread = model.posts(spark, folder, "thread_id").groupBy("thread_id").agg(F.count("*").alias("n"))
    return _where(spark, folder, per_thread).groupBy("section_id", "section").agg(F.sum("n").alias("posts_count"), F.count("*").alias("threads_count")).orderBy(F.desc("posts_count"), "section_id").limit(10)


@query("""SELECT users.id, username, n AS posts_count, join_date, religion, gender FROM (SELECT user_id, count(*) AS n FROM posts GROUP BY user_id ORDER BY n DESC, user_id LIMIT 21) JOIN users ON users.id = user_id ORDER BY n DESC, users.id LIMIT 20""")
def top_users(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty users with most posts."""
    counts = model.posts(spark, folder, "user_id").filter("user_id is not null").groupBy("user_id").agg(F.count("*").alias("posts_count"))
    own = model.users(spark, folder, "username", "join_date", "religion", "gender")
    return counts.join(own, counts.user_id == own.id).select("id", "username", "posts_count", "join_date", "religion", "gender").orderBy(F.desc("posts_count"), "id").limit(20)


@query("""SELECT token AS lemma, count(*) AS frequency, count(DISTINCT id) AS posts_with_word FROM annotated WHERE is_alpha AND NOT is_stop AND length(token) > 3 GROUP BY token ORDER BY frequency DESC, lemma LIMIT 50""")
def top_lemmas(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty most frequent words that carry a topic.

    A post's words are one row, so both counts aggregate before anything is shuffled; only then are words judged.
    """
    words = model.post_words(spark, folder)
    all_of, once = (words.select(F.explode(c).alias("token")).groupBy("token").agg(F.count("*").alias(n)) for c, n in ((F.col("w"), "frequency"), (F.array_distinct("w"), "posts_with_word")))
    # the condition goes into the count: as a filter on the word it would be pushed below the aggregation
    kept = model.annotate(all_of).selectExpr("token", "lemma", "CASE WHEN is_alpha AND NOT is_stop AND length(lemma) > 3 THEN frequency END AS frequency").filter("frequency is not null")
    return kept.join(once, "token").select("lemma", "frequency", "posts_with_word").orderBy(F.desc("frequency"), "lemma").limit(50)


@query("""SELECT pos, count(*) AS n, round(count(*)::DOUBLE * 100 / sum(count(*)) OVER (), 2) AS percentage FROM annotated WHERE is_alpha GROUP BY pos ORDER BY n DESC""")
def pos_share(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each word class; words are counted first and judged once each."""
    words = model.post_words(spark, folder).select(F.explode("w").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    counts = model.annotate(words).selectExpr("pos", "CASE WHEN is_alpha THEN n END AS n").groupBy("pos").agg(F.sum("n").alias("n")).filter("n is not null")
    return counts.selectExpr("pos", "n", "round(cast(n as double) * 100 / sum(n) over (), 2) AS percentage").orderBy(F.desc("n"))


@query("""SELECT case_form, count(*) AS frequency, count(DISTINCT id) AS posts_count FROM annotated WHERE pos = 'NOUN' GROUP BY case_form ORDER BY frequency DESC""")
def noun_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Cases of nouns, read from the JSON of features; words are counted first and judged once each, and once in each post."""
    case = lambda t: F.when(tk.word_class(t) == "NOUN", F.get_json_object(tk.morphology(t), "$.Case"))
    posts = model.post_words(spark, folder)
    words = posts.select(F.explode("w").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    frequency = words.select(case(F.col("token")).alias("case_form"), "n").filter("case_form is not null").groupBy("case_form").agg(F.sum("n").alias("frequency"))
    own = posts.select(F.explode(F.array_distinct(F.transform(F.array_distinct("w"), case))).alias("case_form")).filter("case_form is not null").groupBy("case_form").agg(F.count("*").alias("posts_count"))
    return frequency.join(own, "case_form").select("case_form", "frequency", "posts_count").orderBy(F.desc("frequency"))


@query("""SELECT forum, gender, count(*) AS frequency FROM annotated JOIN places USING (thread_id) WHERE pos IN ('NOUN', 'ADJ') GROUP BY forum, gender ORDER BY forum, frequency DESC""")
def genders_by_forum(spark: SparkSession, folder: str) -> DataFrame:
    """Grammatical genders in each forum; words are counted by forum first and judged once each."""
    words = model.post_words(spark, folder).join(model.places(spark, folder).select("thread_id", "forum"), "thread_id").select("forum", F.explode("w").alias("token"))
    counts = model.annotate(words.groupBy("forum", "token").agg(F.count("*").alias("n")))
    own = counts.select("forum", F.get_json_object("morph", "$.Gender").alias("gender"), F.when(F.col("pos").isin("NOUN", "ADJ"), F.col("n")).alias("n"))
    return own.groupBy("forum", "gender").agg(F.sum("n").alias("frequency")).filter("frequency is not null").orderBy("forum", F.desc("frequency"))


@query("""SELECT p.id, forum, content, polarity, subjectivity, u.username, p.post_date FROM linguistics l JOIN posts p ON p.id = l.id JOIN users u ON p.user_id = u.id JOIN places ON p.thread_id = places.thread_id WHERE polarity > 0.5 ORDER BY polarity DESC, subjectivity DESC, p.id LIMIT 10""")
def most_positive_posts(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most positive posts; contents are fetched for the ten only."""
    scored = model.post_linguistics(spark, folder, "user_id").filter("polarity > 0.5 and user_id is not null").select("id", "thread_id", "user_id", "polarity", "subjectivity")
    known = model.users(spark, folder, "username").select(F.col("id").alias("user_id"), "username")
    best = _where(spark, folder, scored.join(known, "user_id")).orderBy(F.desc("polarity"), F.desc("subjectivity"), "id").limit(10)
    return model.posts(spark, folder, "content", "post_date").join(F.broadcast(best), "id").select("id", "forum", "content", "polarity", "subjectivity", "username", "post_date").orderBy(F.desc("polarity"), F.desc("subjectivity"), "id")


@query("""SELECT forum, count(*) AS analyzed_posts, round(avg(polarity), 3) AS avg_sentiment, round(avg(subjectivity), 3) AS avg_subjectivity, round(avg(greatest(0.0, least(100.0, raw_readability))), 1) AS avg_readability, round(avg(raw_readability), 1) AS avg_raw FROM linguistics JOIN places USING (thread_id) GROUP BY forum HAVING count(*) > 50 ORDER BY avg_sentiment DESC""")
def sentiment_by_forum(spark: SparkSession, folder: str) -> DataFrame:
    """Mean sentiment and readability of forums with more than fifty posts."""
    own = _where(spark, folder, model.post_linguistics(spark, folder)).groupBy("forum").agg(F.count("*").alias("analyzed_posts"), F.round(F.avg("polarity"), 3).alias("avg_sentiment"), F.round(F.avg("subjectivity"), 3).alias("avg_subjectivity"), F.round(F.avg("readability"), 1).alias("avg_readability"), F.round(F.avg("raw_readability"), 1).alias("avg_raw"))
    return own.filter("analyzed_posts > 50").orderBy(F.desc("avg_sentiment"))


@query("""SELECT section_id, section, count(*) AS analyzed_posts, round(avg(raw_readability), 2) AS avg_readability, round(avg(avg_sentence_length), 2) AS avg_sentence_len, round(avg(word_count), 0) AS avg_words FROM linguistics JOIN places USING (thread_id) GROUP BY section_id, section HAVING count(*) > 100 ORDER BY avg_readability DESC, section_id""")
def readability_by_section(spark: SparkSession, folder: str) -> DataFrame:
    """Readability (before its clamp) and lengths in sections with more than a hundred posts."""
    own = _where(spark, folder, model.post_linguistics(spark, folder)).groupBy("section_id", "section").agg(F.count("*").alias("analyzed_posts"), F.round(F.avg("raw_readability"), 2).alias("avg_readability"), F.round(F.avg("avg_sentence_length"), 2).alias("avg_sentence_len"), F.round(F.avg("word_count"), 0).alias("avg_words"))
    return own.filter("analyzed_posts > 100").orderBy(F.desc("avg_readability"), "section_id")


@query(f"""SELECT forum, count(DISTINCT id) AS posts_with_keywords, count(DISTINCT token) AS unique_words FROM annotated JOIN places USING (thread_id) WHERE token IN ({quoted(KEYWORDS)}) AND is_alpha GROUP BY forum_id, forum ORDER BY posts_with_keywords DESC""")
def keyword_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts of each forum with a keyword; the other words never leave their row."""
    hits = model.post_words(spark, folder).select("id", "thread_id", F.explode(F.array_intersect("w", F.array(*map(F.lit, KEYWORDS)))).alias("lemma"))
    return _where(spark, folder, hits).groupBy("forum_id", "forum").agg(F.count_distinct("id").alias("posts_with_keywords"), F.count_distinct("lemma").alias("unique_words")).drop("forum_id").orderBy(F.desc("posts_with_keywords"))


@query(f"""SELECT forum, token AS lemma, count(*) AS frequency, count(DISTINCT id) AS posts_count FROM annotated JOIN places USING (thread_id) WHERE token IN ({quoted(VOCABULARY)}) AND is_alpha GROUP BY forum, token ORDER BY forum, frequency DESC""")
def keyword_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """How often each forum uses each keyword."""
    own = model.post_words(spark, folder).withColumn("w", F.filter("w", lambda t: t.isin(VOCABULARY))).filter(F.size("w") > 0)
    own = own.select("thread_id", "w", F.explode(F.array_distinct("w")).alias("lemma")).select("thread_id", "lemma", F.size(F.filter("w", lambda t: t == F.col("lemma"))).alias("n"))
    return _where(spark, folder, own).groupBy("forum", "lemma").agg(F.sum("n").alias("frequency"), F.count("*").alias("posts_count")).orderBy("forum", F.desc("frequency"))


_KEY = ["weekly_name", "issue_number", "issue_year"]
# an author's name somewhere in the packed field, upper and lower case of A to Z alike
_NAMED = "contains(translate(article_authors, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"


def _issues(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "weekly_issues", "id", *_KEY, *columns).withColumnRenamed("id", "issue_id")


@query(f""", known AS (SELECT * FROM articles SEMI JOIN weekly_issues USING (weekly_name, issue_number, issue_year)), counted AS (SELECT weekly_name, count(*) AS n FROM known GROUP BY weekly_name), named AS (SELECT weekly_name, count(DISTINCT name) AS n FROM known JOIN authors ON {_NAMED} GROUP BY weekly_name)
SELECT weekly_name AS weekly, count(*) AS issues_count, coalesce(any_value(counted.n), 0) AS articles_count, coalesce(any_value(named.n), 0) AS authors_count, min(issue_date) AS first_issue, max(issue_date) AS last_issue FROM weekly_issues LEFT JOIN counted USING (weekly_name) LEFT JOIN named USING (weekly_name) GROUP BY weekly_name""")
def weeklies_overview(spark: SparkSession, folder: str) -> DataFrame:
    """Issues, articles and authors of each weekly; authors by containment in the packed field."""
    issues = _issues(spark, folder, "issue_date").groupBy("weekly_name").agg(F.count("*").alias("issues_count"), F.min("issue_date").alias("first_issue"), F.max("issue_date").alias("last_issue"))
    articles = table(spark, folder, "articles", "id", *_KEY, "article_authors").join(_issues(spark, folder).select(*_KEY), _KEY, "left_semi")
    counts = articles.groupBy("weekly_name").agg(F.count("*").alias("articles_count"))
    names = containing(articles.select("weekly_name", "article_authors").distinct(), "article_authors", model.authors(spark, folder), "name").groupBy("weekly_name").agg(F.count_distinct("name").alias("authors_count"))
    out = issues.join(counts, "weekly_name", "left").join(names, "weekly_name", "left").fillna(0, ["articles_count", "authors_count"])
    return out.select(F.col("weekly_name").alias("weekly"), "issues_count", "articles_count", "authors_count", "first_issue", "last_issue").orderBy(F.desc("articles_count"))


_SECTIONS = "(SELECT DISTINCT weekly_name, issue_number, issue_year, section_name FROM articles WHERE section_name IS NOT NULL)"


@query(f"""SELECT weekly_name AS weekly, section_name, sum(n)::BIGINT AS articles_count, round(sum(words) / sum(with_words), 3) AS avg_word_count FROM weekly_issues JOIN {_SECTIONS} USING (weekly_name, issue_number, issue_year)
JOIN (SELECT weekly_name, issue_number, issue_year, count(*) AS n, count(article_word_count) AS with_words, sum(article_word_count)::DOUBLE AS words FROM articles GROUP BY ALL) USING (weekly_name, issue_number, issue_year) GROUP BY weekly_name, section_name ORDER BY articles_count DESC, weekly, section_name LIMIT 20""")
def weekly_sections_fanout(spark: SparkSession, folder: str) -> DataFrame:
    """Sections by articles, as the catalogue states it: every section of an issue gets all the issue's articles."""
    articles = table(spark, folder, "articles", "id", *_KEY, "section_name", "article_word_count")
    sections = articles.filter("section_name is not null").select(*_KEY, "section_name").distinct()
    per_issue = articles.groupBy(*_KEY).agg(F.count("*").alias("n"), F.count("article_word_count").alias("with_words"), F.sum("article_word_count").alias("words"))
    out = _issues(spark, folder).join(sections, _KEY).join(per_issue, _KEY).groupBy(F.col("weekly_name").alias("weekly"), "section_name")
    return out.agg(F.sum("n").alias("articles_count"), F.round(F.sum("words") / F.sum("with_words"), 3).alias("avg_word_count")).orderBy(F.desc("articles_count"), "weekly", "section_name").limit(20)


@query("""SELECT weekly_name AS weekly, section_name, count(*) AS articles_count, round(avg(article_word_count), 3) AS avg_word_count FROM articles WHERE section_name IS NOT NULL GROUP BY weekly_name, section_name ORDER BY articles_count DESC, weekly, section_name LIMIT 20""", prelude=False)
def weekly_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections by their own articles."""
    own = table(spark, folder, "articles", "weekly_name", "section_name", "article_word_count").filter("section_name is not null")
    return own.groupBy(F.col("weekly_name").alias("weekly"), "section_name").agg(F.count("*").alias("articles_count"), F.round(F.avg("article_word_count"), 3).alias("avg_word_count")).orderBy(F.desc("articles_count"), "weekly", "section_name").limit(20)


@query(f"""SELECT name AS author, count(*) AS articles_count, count(DISTINCT weekly_name) AS weeklies_count, round(avg(article_word_count), 3) AS avg_word_count, min(scraped_at) AS first_article, max(scraped_at) AS last_article FROM articles, authors WHERE {_NAMED} GROUP BY name ORDER BY articles_count DESC, author LIMIT 20""")
def top_authors(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty authors with most articles, by containment."""
    articles = table(spark, folder, "articles", "id", "weekly_name", "article_authors", "article_word_count", "scraped_at")
    hits = containing(articles, "article_authors", model.authors(spark, folder), "name")
    out = hits.groupBy(F.col("name").alias("author")).agg(F.count("*").alias("articles_count"), F.count_distinct("weekly_name").alias("weeklies_count"), F.round(F.avg("article_word_count"), 3).alias("avg_word_count"), F.min("scraped_at").alias("first_article"), F.max("scraped_at").alias("last_article"))
    return out.orderBy(F.desc("articles_count"), "author").limit(20)


@query("""SELECT weekly_name AS weekly, count(*) AS articles_count, round(avg(article_word_count), 3) AS avg_word_count, min(article_word_count) AS min_word_count, max(article_word_count) AS max_word_count, count(article_content) AS articles_with_content
FROM articles WHERE (weekly_name, issue_number, issue_year) IN (SELECT (weekly_name, issue_number, issue_year) FROM weekly_issues) GROUP BY weekly_name""", prelude=False)
def article_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of articles of each weekly."""
    articles = table(spark, folder, "articles", *_KEY, "article_word_count", "article_content").withColumn("has", F.col("article_content").isNotNull()).drop("article_content")
    out = articles.join(_issues(spark, folder), _KEY).groupBy(F.col("weekly_name").alias("weekly"))
    return out.agg(F.count("*").alias("articles_count"), F.round(F.avg("article_word_count"), 3).alias("avg_word_count"), F.min("article_word_count").alias("min_word_count"), F.max("article_word_count").alias("max_word_count"), F.count_if("has").alias("articles_with_content")).orderBy(F.desc("articles_count"))


@query(f""", known AS (SELECT * FROM articles SEMI JOIN weekly_issues USING (weekly_name, issue_number, issue_year)), counted AS (SELECT weekly_name, count(*) AS n FROM known GROUP BY weekly_name), named AS (SELECT weekly_name, count(DISTINCT name) AS n FROM known JOIN authors ON {_NAMED} GROUP BY weekly_name), parts AS (SELECT weekly_name, count(*) AS n FROM {_SECTIONS} SEMI JOIN weekly_issues USING (weekly_name, issue_number, issue_year) GROUP BY weekly_name)
SELECT weekly_name AS weekly, count(*) AS issues, coalesce(any_value(parts.n), 0) AS sections, coalesce(any_value(counted.n), 0) AS articles, coalesce(any_value(named.n), 0) AS authors FROM weekly_issues LEFT JOIN counted USING (weekly_name) LEFT JOIN named USING (weekly_name) LEFT JOIN parts USING (weekly_name) GROUP BY weekly_name""")
def weeklies_progress(spark: SparkSession, folder: str) -> DataFrame:
    """How many issues, sections, articles and authors each weekly has."""
    sections = table(spark, folder, "articles", *_KEY, "section_name").filter("section_name is not null").distinct().join(_issues(spark, folder), _KEY, "left_semi").groupBy("weekly_name").agg(F.count("*").alias("sections"))
    out = weeklies_overview(spark, folder).join(sections.withColumnRenamed("weekly_name", "weekly"), "weekly", "left").fillna(0, ["sections"])
    return out.select("weekly", F.col("issues_count").alias("issues"), "sections", F.col("articles_count").alias("articles"), F.col("authors_count").alias("authors"))


def _domains(spark: SparkSession, folder: str) -> DataFrame:
    return model.post_urls(spark, folder).groupBy("domain", "category", "trust").agg(F.count("*").alias("total_references"))


@query("""SELECT category, count(*) AS domains, sum(total_references)::BIGINT AS refs FROM domains GROUP BY category ORDER BY refs DESC""")
def category_refs(spark: SparkSession, folder: str) -> DataFrame:
    """Domains and references by category."""
    return _domains(spark, folder).groupBy("category").agg(F.count("*").alias("domains"), F.sum("total_references").alias("refs")).orderBy(F.desc("refs"))


@query("""SELECT domain, category, count(*) AS total_references, count(DISTINCT id) AS posts_with_domain FROM urls GROUP BY domain, category ORDER BY total_references DESC, domain LIMIT 20""")
def top_domains(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty domains with most references."""
    per_post = model.post_urls(spark, folder).groupBy("id", "domain", "category").agg(F.count("*").alias("n"))
    return per_post.groupBy("domain", "category").agg(F.sum("n").alias("total_references"), F.count("*").alias("posts_with_domain")).orderBy(F.desc("total_references"), "domain").limit(20)


@query(f"""SELECT forum, count(*) AS religious_domains, sum(n * total_references)::BIGINT AS total_religious_links FROM (SELECT forum, domain, count(*) AS n FROM urls JOIN places USING (thread_id) WHERE {RELIGIOUS} GROUP BY forum, domain) JOIN domains USING (domain) GROUP BY forum""")
def religious_domains_by_forum(spark: SparkSession, folder: str) -> DataFrame:
    """Religious domains of each forum, as the catalogue states it: each link adds its domain's whole count."""
    religious = ur.is_religious(F.col("domain"), OWN_DOMAINS["religious"])
    own = model.post_urls(spark, folder).filter(religious).groupBy("thread_id", "domain").agg(F.count("*").alias("n"))
    total = own.groupBy("domain").agg(F.sum("n").alias("total_references"))
    out = _where(spark, folder, own).groupBy("forum", "domain").agg(F.sum("n").alias("n")).join(total, "domain").groupBy("forum")
    return out.agg(F.count("*").alias("religious_domains"), F.sum(F.col("n") * F.col("total_references")).alias("total_religious_links")).orderBy(F.desc("total_religious_links"))


@query("""SELECT forum, url_type, count(*) AS n, count(DISTINCT id) AS posts_count FROM urls JOIN places USING (thread_id) GROUP BY forum, url_type ORDER BY forum, n DESC""")
def url_types_by_forum(spark: SparkSession, folder: str) -> DataFrame:
    """Types of addresses in each forum."""
    per_post = model.post_urls(spark, folder).groupBy("id", "thread_id", "url_type").agg(F.count("*").alias("n"))
    return _where(spark, folder, per_post).groupBy("forum", "url_type").agg(F.sum("n").alias("n"), F.count("*").alias("posts_count")).orderBy("forum", F.desc("n"))


@query("""SELECT forum, count(DISTINCT domain) AS unique_domains, round(avg(trust), 3) AS avg_trust_score, count(CASE WHEN trust >= 0.8 THEN 1 END) AS high_trust_links, count(CASE WHEN trust < 0.6 THEN 1 END) AS low_trust_links FROM urls JOIN places USING (thread_id) GROUP BY forum ORDER BY avg_trust_score DESC""")
def trust_by_forum(spark: SparkSession, folder: str) -> DataFrame:
    """Trust in the domains that each forum links to."""
    own = model.post_urls(spark, folder).groupBy("thread_id", "domain", "trust").agg(F.count("*").alias("n"))
    out = _where(spark, folder, own).groupBy("forum", "domain", "trust").agg(F.sum("n").alias("n")).groupBy("forum")
    high, low = F.when(F.col("trust") >= 0.8, F.col("n")), F.when(F.col("trust") < 0.6, F.col("n"))
    return out.agg(F.count("*").alias("unique_domains"), F.round(F.sum(F.col("trust") * F.col("n")) / F.sum("n"), 3).alias("avg_trust_score"), F.coalesce(F.sum(high), F.lit(0).cast("long")).alias("high_trust_links"), F.coalesce(F.sum(low), F.lit(0).cast("long")).alias("low_trust_links")).orderBy(F.desc("avg_trust_score"))


def _mentions(spark: SparkSession, folder: str, labels: list[str]) -> DataFrame:
    own = model.post_entities(spark, folder).filter(F.col("label").isin(labels)).groupBy("id", "thread_id", "entity").agg(F.count("*").alias("n"))
    return _where(spark, folder, own)


@query("""SELECT forum, entity AS person, count(*) AS mentions, count(DISTINCT id) AS posts_count FROM entities JOIN places USING (thread_id) WHERE label IN ('PERSON', 'PER') GROUP BY forum, entity HAVING count(*) > 5 ORDER BY forum, mentions DESC""")
def persons_by_forum(spark: SparkSession, folder: str) -> DataFrame:
    """Persons named more than five times in a forum."""
    own = _mentions(spark, folder, ["PERSON", "PER"]).groupBy("forum", F.col("entity").alias("person")).agg(F.sum("n").alias("mentions"), F.count("*").alias("posts_count"))
    return own.filter("mentions > 5").orderBy("forum", F.desc("mentions"))


@query("""SELECT entity AS organization, count(*) AS mentions, count(DISTINCT forum) AS forums_mentioned FROM entities JOIN places USING (thread_id) WHERE label IN ('ORG', 'ORGANIZATION') GROUP BY entity ORDER BY mentions DESC, organization LIMIT 15""")
def top_organizations(spark: SparkSession, folder: str) -> DataFrame:
    """The fifteen organisations named most."""
    own = _mentions(spark, folder, ["ORG", "ORGANIZATION"]).groupBy("entity", "forum").agg(F.sum("n").alias("n"))
    return own.groupBy(F.col("entity").alias("organization")).agg(F.sum("n").alias("mentions"), F.count("*").alias("forums_mentioned")).orderBy(F.desc("mentions"), "organization").limit(15)


def _places_sql(parts: list[str]) -> str:
    return "SELECT forum, entity AS place, count(*) AS mentions FROM entities JOIN places USING (thread_id) WHERE label IN ('GPE', 'LOC', 'LOCATION') AND (" + " OR ".join(f"entity LIKE '%{p}%'" for p in parts) + ") GROUP BY forum, entity ORDER BY forum, mentions DESC"


def _places(spark: SparkSession, folder: str, parts: list[str]) -> DataFrame:
    part = reduce(lambda a, b: a | b, [F.col("entity").contains(p) for p in parts])
    return _mentions(spark, folder, ["GPE", "LOC", "LOCATION"]).filter(part).groupBy("forum", F.col("entity").alias("place")).agg(F.sum("n").alias("mentions")).orderBy("forum", F.desc("mentions"))


@query(_places_sql(PLACES))
def places_by_forum(spark: SparkSession, folder: str) -> DataFrame:
    """Holy places by forum."""
    return _places(spark, folder, PLACES)


@query(_places_sql(TOWNS))
def towns_by_forum(spark: SparkSession, folder: str) -> DataFrame:
    """Towns whose name has one of a few parts, by forum."""
    return _places(spark, folder, TOWNS)


@query("""SELECT forum, count(*) AS posts_with_entities, sum(n)::BIGINT AS total_entities, sum(persons)::BIGINT AS persons, sum(orgs)::BIGINT AS organizations, sum(gpes)::BIGINT AS places, round(avg(n), 2) AS avg_entities_per_post
FROM (SELECT id, thread_id, count(*) AS n, count(*) FILTER (label = 'PERSON') AS persons, count(*) FILTER (label = 'ORG') AS orgs, count(*) FILTER (label = 'GPE') AS gpes FROM entities GROUP BY id, thread_id) JOIN places USING (thread_id) GROUP BY forum ORDER BY total_entities DESC""")
def entity_stats_by_forum(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of each kind by forum, from counters of each post."""
    kinds = {"persons": "PERSON", "organizations": "ORG", "places": "GPE"}
    per_post = model.post_entities(spark, folder).groupBy("id", "thread_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("label") == v).alias(k) for k, v in kinds.items()])
    return _where(spark, folder, per_post).groupBy("forum").agg(F.count("*").alias("posts_with_entities"), F.sum("n").alias("total_entities"), *[F.sum(k).alias(k) for k in kinds], F.round(F.avg("n"), 2).alias("avg_entities_per_post")).orderBy(F.desc("total_entities"))


@query("""SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS posts_count FROM posts WHERE created_at IS NOT NULL GROUP BY month ORDER BY month""")
def monthly_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts of each month."""
    return model.posts(spark, folder, "created_at").filter("created_at is not null").groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("posts_count")).orderBy("month")


@query("""SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS posts_analyzed, round(avg(polarity), 3) AS avg_sentiment, round(avg(raw_readability), 1) AS avg_readability FROM linguistics WHERE created_at IS NOT NULL GROUP BY month HAVING count(*) > 10 ORDER BY month""")
def monthly_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    """Mean sentiment of each month with more than ten posts."""
    own = model.post_linguistics(spark, folder, "created_at").filter("created_at is not null").groupBy(F.date_format("created_at", "yyyy-MM").alias("month"))
    return own.agg(F.count("*").alias("posts_analyzed"), F.round(F.avg("polarity"), 3).alias("avg_sentiment"), F.round(F.avg("raw_readability"), 1).alias("avg_readability")).filter("posts_analyzed > 10").orderBy("month")


@query("""SELECT 'forums' AS what, count(*) AS n FROM forums UNION ALL SELECT 'posts', count(*) FROM posts UNION ALL SELECT 'users', count(*) FROM users UNION ALL SELECT 'threads', count(*) FROM threads""")
def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many forums, posts, users and threads there are."""
    frames = {"forums": table(spark, folder, "forums", "id"), "posts": table(spark, folder, "forum_posts", "id"), "users": table(spark, folder, "forum_users", "id"), "threads": table(spark, folder, "forum_threads", "id")}
    return reduce(DataFrame.unionByName, [df.distinct().agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, df in frames.items()])


@query("""SELECT 'tokens' AS analysis, count(DISTINCT id) AS n FROM tokens UNION ALL SELECT 'linguistics', count(*) FROM linguistics UNION ALL SELECT 'urls', count(DISTINCT id) FROM urls UNION ALL SELECT 'NER', count(DISTINCT id) FROM entities""")
def analysis_progress(spark: SparkSession, folder: str) -> DataFrame:
    """How many posts each analysis has something on."""
    words = model.posts(spark, folder, "content").filter(F.col("content").rlike(tk.WORD)).agg(F.count("*").alias("n"))
    parts = [words.select(F.lit("tokens").alias("analysis"), "n"), words.select(F.lit("linguistics").alias("analysis"), "n")]
    parts += [df.select("id").distinct().agg(F.count("*").alias("n")).select(F.lit(k).alias("analysis"), "n") for k, df in (("urls", model.post_urls(spark, folder)), ("NER", model.post_entities(spark, folder)))]
    return reduce(DataFrame.unionByName, parts)


__all__ = ["QUERIES", "SQL", "ascii_lower"]
